import random
import re

import numpy as np
import pytest

from quadrel.llm.common import BY_BAND, candidate_groups, connected_components
from quadrel.llm.jaccard import JaccardParams, join_similar, ngrams, signatures, similar_pairs
from quadrel.llm.queries import OP5_SQL, op5_ngram_jaccard
from tests.oracle import same


def grams(text, n=5):
    words = re.findall(r"[^\t\n\x0b\f\r ]+", text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def linked(a, b):
    x, y = grams(a), grams(b)
    return a == b or bool(x & y) and len(x & y) * 5 >= 4 * len(x | y)


def brute(rows):
    docs = [(k, t or "") for k, t in rows]
    links = [[j for j, (q, u) in enumerate(docs) if j != i and k is not None and q is not None and linked(t, u)] for i, (k, t) in enumerate(docs)]
    out = []
    for i, (k, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        out.append((k, None if k is None else min(docs[j][0] for j in seen), len(links[i])))
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30, 90, 200]))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "  ", "\n"]).join(copy))
    return out


def test_ngrams_and_pairs_equal_brute_force():
    texts = corpus(1, 40) + ["", " ", "é é x", "\n\ta b c d e f"]
    hashes, bounds = ngrams(texts, 5)
    table = {}
    for i, t in enumerate(texts):
        own = set(hashes[bounds[i] : bounds[i + 1]].tolist())
        assert len(own) == len(grams(t))
        table[i] = own
    a, b = similar_pairs(texts, JaccardParams())
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams(texts[i]) & grams(texts[j]) and linked(texts[i], texts[j]) and (texts[i] != texts[j] or grams(texts[i]))}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    assert all((table[i] == table[j]) == (grams(texts[i]) == grams(texts[j])) for i in table for j in table)


def test_bands_reach_target():
    bands, rows = JaccardParams().bands()
    assert (1 - 0.8**rows) ** bands <= 1e-6 and bands * rows <= 384
    code = signatures(["a b c d e f", "a b c d e f", "", "x"], JaccardParams())
    assert (code[0] == code[1]).all() and not code[2].any() and code[3].all() and not (code[0] == code[3]).any()


@pytest.mark.parametrize("block", [512, 3])
def test_groups_against_brute_force(spark, block):
    texts = corpus(2, 30)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, texts[7]), (1002, texts[7]), (None, texts[7]), (1003, "long words here " * 40000), (1004, "long words here " * 40000 + "end")]
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, rep int, component int")
    got = sorted((tuple(r) for r in join_similar(frame, JaccardParams(block=block)).collect()), key=repr)
    assert got == brute(rows)
    assert join_similar(frame.limit(0)).collect() == []


def test_texts_of_one_key_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (3, a + " end"), (5, b), (9, b + " end"), (7, "alone"), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in join_similar(frame).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (9, 3)]


def test_loose_groups_are_dealt_by_bands(spark):
    """A chain of texts, each like its neighbours only: one component of bands, in which the
    pairs that share none are not compared."""
    words = [f"w{i}" for i in range(4100)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 4000, 10)]
    params = JaccardParams(block=8)
    code = signatures(texts, params)
    frame = spark.createDataFrame([(i, 1, c.tolist()) for i, c in enumerate(code)], "rep long, weight long, bands array<long>")
    groups = {}
    for r in candidate_groups(frame, params.block, 10**9).collect():
        groups.setdefault((r.group, r.pair), []).append((r.rep, r.side))
    assert any(pair >= BY_BAND for _, pair in groups)
    met = {(a, b) for own in groups.values() for a, x in own for b, y in own if a < b and (x != y or x == 0)}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (code[i] == code[j]).any()}
    assert want <= met and len(met) < len(texts) ** 2 / 8
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sorted((tuple(r) for r in join_similar(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()), key=repr)
    assert got == brute(rows)


def test_components_with_hubs(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(90)] + [(399, 1040)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5000, 5000), (None, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]}
    for _ in range(200):
        for u, v in edges:
            if u in label and v in label and u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    assert same(spark, f"/root/testdata/{sf}", op5_ngram_jaccard, OP5_SQL)
