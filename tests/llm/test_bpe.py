import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrel.llm.bpe import Codec, decode_documents, encode_documents
from quadrel.llm.queries import op1_byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TOOL = Codec(RANKS, P.PATTERN, cache_bytes=10_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t'sé1.\x1c\xa0", max_size=80)), max_size=4))
def test_random_texts(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))} if not hasattr(test_random_texts, "enc") else None
    if ranks:
        test_random_texts.enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = TOOL.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == [test_random_texts.enc.encode_ordinary(t) for t in texts]
    assert TOOL.decode(coded) == [t.encode() for t in texts]


def test_long_words_match_library(public):
    rng = random.Random(4)
    pieces = ["etaoinshrdlu", "ab", "the", "-", "=-", "0123456789", "é日本", "thers"]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(90, 700))) for p in pieces for _ in range(12)]
    texts += [" " + "".join(rng.choice(["the", "ing", "ABab", "x", "--"]) for _ in range(rng.randint(40, 200))) for _ in range(30)]
    texts += [unit * n for unit in ("a", "the", " ", "\n", "é", "ther") for n in (95, 96, 97, 333)]
    coded = Codec(RANKS, P.PATTERN).encode(texts)
    for text, ids in zip(texts, coded, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(text), text[:60]


def test_very_long_words_end_soon(public):
    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(100_000)), "the" * 33_000, "the" * 9000 + "ther" + "the" * 9000, "a" * 100_000, " " * 100_000]
    begin = time.process_time()
    coded = Codec(RANKS, P.PATTERN).encode(texts)
    assert time.process_time() - begin < 20
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == [public.encode_ordinary(t) for t in texts]


def test_repeated_tokens_end_soon(public):
    vocabulary = [t for t in (public.decode([i]) for i in range(public.n_vocab - 1)) if t.isalpha() and t.isascii() and 1 < len(t) < 13]
    units = [("ext", 100_000), ("rent", 100_000), ("exec", 100_000), ("iken", 100_000), ("hent", 100_000)]
    units += [(u, 20_000) for u in random.Random(7).sample(vocabulary, 20)]
    tool = Codec(RANKS, P.PATTERN)
    for unit, n in units:
        text = (unit * n)[:n]
        begin = time.process_time()
        ids = tool.encode([text])[0]
        assert time.process_time() - begin < 5, unit
        assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(text), unit


def test_parts_are_put_together_exactly(public, monkeypatch):
    """Small parts, so that agreement, new beginnings and the way without parts all occur."""
    rng, done = random.Random(11), {"agreed": 0, "restarted": 0, "whole": 0}
    for name, value in (("HUGE", 96), ("PART", 40), ("OVERLAP", 12)):
        monkeypatch.setattr(f"quadrel.llm.bpe.{name}", value)
    agreed, restarted = Codec._agreed, Codec._restarted

    def counted(name, fn):
        def run(*args):
            step = fn(*args)
            done[name] += step is not None
            done["whole"] += name == "restarted" and step is None
            return step

        return staticmethod(run)

    monkeypatch.setattr(Codec, "_agreed", counted("agreed", agreed))
    monkeypatch.setattr(Codec, "_restarted", counted("restarted", restarted))
    tool = Codec(RANKS, P.PATTERN)
    pieces = ["etaoinshrdlu", ["ext", "rent", "exec", "iken"], ["a", "aa", "b"], ["-", "=", "--"], ["é", "日本", "о"], ["the", "ther", "e"]]
    texts = ["".join(rng.choice(p) for _ in range(rng.randint(60, 400))) for p in pieces for _ in range(15)]
    texts += [u * rng.randint(100 // len(u), 500 // len(u) + 1) for u in ("a", "-", "ext", "rent", "ab", " ", "0", "quartered", "=" * 9 + "-")]
    for text, ids in zip(texts, tool.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(text), text[:60]
    assert done["agreed"] > 100 and done["restarted"] > 5, done


def test_documents_match_library(spark, public):
    rows = [(1, "Hello  world's <|endoftext|> 123\n\n x", "clash"), (2, None, "c"), (3, "", "c"), (None, "a" * 300, "c"), (4, "word " * 30000, "c"), (4, "word " * 30000, "c"), (5, "é　漢字\r\n\t.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_documents(docs, RANKS, P.PATTERN)
    want = sorted((k or 0, public.encode_ordinary(t or ""), t or "") for k, t, _ in rows)
    out = sorted((r.doc_id or 0, list(r.ids), r) for r in got.collect())
    for (k, ids, r), (key, expected, text) in zip(out, want, strict=True):
        assert (k, ids, r.n_tokens) == (key, expected, len(expected))
        assert r.ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    texts = {(r.doc_id, r.text) for r in decode_documents(got, RANKS, P.PATTERN).collect()}
    assert texts == {(k, t or "") for k, t, _ in rows}


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).collect() == []


def test_query_against_library(spark, sf_dir, public):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r.doc_id: r for r in op1_byte_bpe(spark, sf_dir).collect()}
    assert out.keys() == docs.keys()
    for k, text in docs.items():
        ids = public.encode_ordinary(text)
        assert (out[k].n_tokens, out[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert out[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
