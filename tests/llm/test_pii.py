import hashlib
import itertools
import re
import time

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from quadrel.llm.pii import KINDS, CrfParams, Field, base_spans, blanked, find_personal_data, fit_field, more_spans, words_of
from quadrel.llm.queries import op4_pii_skip_chain

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    """The contract, read literally."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and doubled % 10 == 0, 9 <= len(digits) <= 15][kind]
            if ok:
                out.append((kind, *m.span()))
    return out


TEXT = st.one_of(
    st.text(max_size=30),
    st.text(alphabet="ab.@-+ 0159()é", max_size=60),
    st.lists(st.sampled_from(["a.b@c.de", "@", "x@", "4111 1111-1111 1111", "+1 (555) 010-9999", "10.0.0.256", "1.2.3.4", " ", ".", "é", "0", "a@b.c@d.e"]), max_size=8).map("".join),
)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_patterns_read_literally(text):
    assert base_spans(text) == plain(text)


def expected_digest(text):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain(text)).encode()).hexdigest()


TRAINING = [f"call +1 ({200 + i}) 555-{1000 + i} or mail user{i}.x@mail{i % 9}.example.com from 10.0.{i}.7 card {v} version {i % 9}.{i % 7} of {1900 + i}" for i, v in enumerate(["4111111111111111", "5500005555555559", "4012888888881881"] * 30)]


def test_field_widens_and_agrees():
    field = fit_field(TRAINING)
    text = "mail longname.42@mail.example.com . Much later longname.42 wrote again in 1984, version 3.2"
    base = base_spans(text)
    assert [(KINDS[k], text[a:b]) for k, a, b in more_spans(text, base, field, CrfParams(sure=0.5))] == [("email", "longname.42")]
    merged = "dial +1 (269) 555-3296 4524132264652811 now"
    assert any(text_ == "+1 (269) 555-3296" for k, a, b in more_spans(merged, base_spans(merged), field, CrfParams()) for text_ in [merged[a:b]])
    clean = "In 1984, 30 people of version 3.2 met 4 times. " * 50
    assert more_spans(clean, base_spans(clean), field, CrfParams()) == []


def test_repeats_are_found_at_the_production_threshold():
    field = fit_field(TRAINING)
    far = "and so on " * 500
    for address, mention in (("longname.42", "longname.42"), ("johnsmith", "JohnSmith"), ("jdoe7", "jdoe7"), ("ann", "Ann"), ("jdoe", "jdoe")):
        for first in ("", "\u0130stanbul, "):
            text = f"{first}mail <{address}@mail.example.com>. {far}Later, {mention}, wrote of {mention}s again"
            found = [(KINDS[k], text[a:b], a) for k, a, b in more_spans(text, base_spans(text), field, CrfParams())]
            want = [("email", mention, text.rindex(f" {mention},") + 1)]
            assert found[:1] == want and (len(address) >= CrfParams().core or found == want), text[:40]


def exact(field, x, near, tie, known):
    """Posteriors by summing over all labellings, words alone: the definition of the field."""
    n, k = len(x), field.unary.shape[1]
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if any(o >= 0 and o != v for o, v in zip(known, labels, strict=True)):
            continue
        score = sum(x[i] @ field.unary[:, v] for i, v in enumerate(labels) if known[i] < 0)
        score += sum(field.chain[labels[i - 1], labels[i]] for i in range(1, n) if near[i])
        score += sum(field.skip[labels[i]] for i in range(n) for j in range(i) if tie[i] == tie[j] and labels[i] == labels[j])
        out[np.arange(n), labels] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_messages_against_exact_inference():
    rng = np.random.default_rng(3)
    for trial in range(60):
        n = int(rng.integers(1, 6))
        field = Field(rng.normal(0, 1, (3, 5)), rng.normal(0, 0.7, (5, 5)), np.full(5, rng.uniform(0, 3)))
        x = rng.normal(0, 1, (n, 3))
        known = np.where(rng.random(n) < 0.3, rng.integers(0, 5, n), -1)
        chain = np.r_[False, rng.random(n - 1) < 0.8]
        alone, pairs = np.arange(n), np.arange(n) // 2
        # Chains, and pairs of like words: no loops, so messages are exact.
        for near, tie in ((chain, alone), (np.zeros(n, bool), pairs)):
            assert np.allclose(field.beliefs(x, near, tie, known, 12), exact(field, x, near, tie, known), atol=1e-6)
        if trial < 20:  # loops: chain and pairs together
            assert np.abs(field.beliefs(x, chain, pairs, known, 12) - exact(field, x, chain, pairs, known)).max() < 0.25


def test_skip_potentials_are_learned():
    agreeing = fit_field(TRAINING)
    assert agreeing.skip.min() > 3
    # The same digits as a card in one place and as a phone number in another, again and again.
    split = [f"card 4111111111111{i:03d} x +4111111111111{i:03d} y 4111111111111{i:03d}" for i in range(300)]
    split = [t for t in split if {k for k, *_ in base_spans(t)} >= {2}]
    assert fit_field(split).skip[2] < agreeing.skip[2]


def test_added_spans_on_planted_mentions():
    import pandas as pd

    texts = [t for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text if t]
    field = fit_field([t for t in texts if re.search("[0-9@]", t)])
    hit = planted = 0
    for n, text in enumerate(texts):
        clean = text.replace("@", " ")
        base = base_spans(clean)
        name = f"mara.{n}quell" if n % 2 else f"oddname{n}x"
        changed = f"{clean} write to <{name}@post{n}.example.org>, please. {clean[:2000]} So said {name} again."
        own = base_spans(changed)
        added = more_spans(changed, own, field, CrfParams())
        at = changed.rindex(f"{name} again")
        planted += 1
        hit += (0, at, at + len(name)) in added
    assert hit >= 0.9 * planted
    without = [t for t in texts if not base_spans(t)]
    assert sum(bool(more_spans(t, [], field, CrfParams())) for t in without) <= 0.02 * len(without)


def test_time_is_linear():
    def seconds(n):
        begin = time.process_time()
        for text in (" ".join(f"user{i}x@mail.example.com" for i in range(n)), " ".join(f"u{i}@m.de u{i}" for i in range(n)), "longname@x.de " + "longname" * n, "9" * (10 * n), "1.1.1." * n, "+1(" * n):
            words_of(text, base_spans(text), 6)
        return time.process_time() - begin

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2000), 0.05)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_field_takes_any_text(text):
    spans = more_spans(text, base_spans(text), fit_field([]), CrfParams(sure=0.0))
    assert all(0 <= a < b <= len(text) for _, a, b in spans)
    words_of(text, base_spans(text), 2)
    assert not any(k in (0,) for k, *_ in base_spans(blanked(text, base_spans(text)))) or "@" in text


def test_redaction():
    assert blanked("a b@c.de 1.2.3.4!", base_spans("a b@c.de 1.2.3.4!")) == "a [EMAIL] [IP]!"
    assert blanked("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a[EMAIL]f"


def test_rows(spark):
    rows = [(1, None, "c"), (None, "", "c"), (2, "x@y.zz " * 30_000, "c"), (2, "x@y.zz " * 30_000, "c"), (3, "9" * 20_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_personal_data(docs, fit_field(TRAINING)).collect()
    assert sorted(((r.doc_id or 0), r.n_email, r.n_card) for r in got) == [(0, 0, 0), (1, 0, 0), (2, 30_000, 0), (2, 30_000, 0), (3, 0, 0)]
    assert find_personal_data(docs.limit(0), fit_field([])).collect() == []


def test_query_against_literal_reading(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op4_pii_skip_chain(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        base = plain(text)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == n for s in base) for n in range(4)]
        assert r.base_sha256 == expected_digest(text)
        every = [s.split(":") for s in r.spans.split(",") if s]
        order = [(KINDS.index(kind), int(a), int(b)) for kind, a, b in every]
        assert order == sorted(order) and set(base) <= set(order)
