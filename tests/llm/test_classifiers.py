import itertools
import zlib

import numpy as np
import pytest

from quadrel.llm.common import labelled_sample
from quadrel.llm.quality import ByteNetwork, ConvParams, score_quality, train_quality
from quadrel.llm.queries import op7_quality_classifier, op9_toxicity
from quadrel.llm.toxicity import VoterParams, fit_label_model, fit_toxicity, poisson_tail, score_toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("query", "label", "threshold", "wanted", "recall"), [(op7_quality_classifier, "quality", 0.7, 0.99, 0.97), (op9_toxicity, "toxic", 0.3, 0.98, 0.85)])
def test_held_out_accuracy(spark, query, label, threshold, wanted, recall):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in own]) >= wanted
    assert np.mean([p for p, t in own if t == 1]) >= recall


def slow_logits(net, text):
    """The network on one text, place by place."""
    p, w = net.params, net.weights
    data = text.encode()
    get = lambda i: data[i] if 0 <= i < len(data) else 0
    out = []
    for start in range(0, max(1, len(data)), p.chunk):
        end = min(start + p.chunk, len(data)) if data else 0
        last = max(end, start + 1)
        conv = np.max([[sum(w["emb"][get(i + k)] @ w["conv"][k][:, f] for k in range(p.width)) for f in range(p.filters)] for i in range(start, last)], axis=0) + w["bias"]
        share = [max(sum(get(j) == get(j - lag) and get(j) != 0 and j >= lag for j in range(i + 1, i + p.run + 1)) / p.run for i in range(start, last)) for lag in p.lags]
        h = np.tanh(np.r_[np.maximum(conv, 0), share] @ w["w1"] + w["b1"])
        out.append(h @ w["w2"] + w["b2"][0])
    return np.mean(out)


def test_network_equals_slow_network():
    net = ByteNetwork(ConvParams(chunk=32, filters=3, lags=(1, 2, 3), run=6))
    texts = ["ab ab ab ab ab ab ab ab ab ab ab cd", "é" * 40 + "x", "q", "y" * 31]
    want = [slow_logits(net, t) for t in texts]
    assert np.allclose(net.logits(texts), want, atol=1e-4)
    assert np.allclose(net.logits(texts[::-1] + [""]), [*want[::-1], slow_logits(net, "")], atol=1e-4)


def test_classifiers_take_any_rows(spark):
    rows = [(1, None, "c"), (None, "", "c"), (2, "x " * 100_000, "c"), (2, "x " * 100_000, "c"), (3, "you idiot moron", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.held_out) for r in score_quality(docs, train_quality(docs, empty)).collect()} == {(1, False), (None, False), (2, False), (3, False)}
    assert score_quality(docs.limit(0), ByteNetwork()).collect() == []
    model = fit_toxicity(["you idiot", "fine day", "a worthless moron", "good", "calm sea"], [1, 0, 1, 0, 0])
    got = score_toxicity(docs, model).collect()
    assert len(got) == 5 and max(got, key=lambda r: r.score).doc_id == 3
    assert score_toxicity(docs, fit_toxicity([], [])).count() == 5


def test_sample_is_bounded_and_not_held_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(5, "dup"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(7, None), (None, 1), (8, 2)], "doc_id long, toxic int")
    texts, marks = labelled_sample(docs, labels, "toxic", 20)
    assert marks == [0] * 20 + [1] * 20
    ids = [5 if t == "dup" else int(t[1:]) for t in texts]
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids) and [int(i % 3 == 0) for i in ids] == marks


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    accuracy = np.array([0.95, 0.85, 0.8, 0.75, 0.7])
    votes = np.stack([np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in accuracy], axis=1)
    votes = np.c_[votes, votes[:, 4], votes[:, 4]]  # two copies of the worst voter
    model = fit_label_model(votes, VoterParams())
    above = model.above(votes)
    says = np.stack([[model.rates[j, c, above[:, j], 2 * c].mean() for c in (0, 1)] for j in range(5)])
    right = says[:, 1] * model.prior + says[:, 0] * (1 - model.prior)
    assert np.abs(right - accuracy).max() < 0.06
    # The copies depend on each other and change no posterior.
    assert sum(model.parents[j, 0] in (4, 5, 6) for j in (4, 5, 6)) == 2
    alone = fit_label_model(votes[:, :5], VoterParams())
    assert np.abs(model.posterior(votes) - alone.posterior(votes[:, :5])).mean() < 0.02
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.94
    assert abs(poisson_tail(7, 0.54) - 1.16e-6) < 2e-6


def correlated_votes(n, seed=3):
    """Classes, and votes of five voters of which the second and third repeat the first, or
    say nothing, most of the time; the true probability of the class, by enumeration."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.35
    draw = lambda hit: np.where(rng.random(n) < hit, np.where(y, 1, -1), np.where(y, -1, 1))
    a = np.where(rng.random(n) < 0.8, draw(0.75), 0)
    b = np.where(rng.random(n) < 0.9, a, draw(0.7))
    c = np.where(rng.random(n) < 0.9, a, draw(0.7))
    d, e = draw(0.8), draw(0.85)
    chance = lambda vote, own, hit: hit if vote == own else 1 - hit if vote == -own else 0.0

    def joint(v, own):
        first = 0.2 if v[0] == 0 else 0.8 * chance(v[0], own, 0.75)
        rest = [0.9 * (v[i] == v[0]) + 0.1 * chance(v[i], own, 0.7) for i in (1, 2)]
        return first * rest[0] * rest[1] * chance(v[3], own, 0.8) * chance(v[4], own, 0.85)

    votes = np.stack([a, b, c, d, e], axis=1)
    truth = {}
    for v in {tuple(row) for row in votes.tolist()}:
        toxic, clean = 0.35 * joint(v, 1), 0.65 * joint(v, -1)
        truth[v] = toxic / (toxic + clean)
    return y, votes, np.array([truth[tuple(row)] for row in votes.tolist()])


@pytest.mark.parametrize("parents", [1, 2])
def test_label_model_equals_enumeration(parents):
    _, votes, _ = correlated_votes(3000)
    model = fit_label_model(votes, VoterParams(parents=parents))
    assert (model.parents >= 0).any()
    every = list(itertools.product((-1, 0, 1), repeat=5))

    def slow(v, c):
        out = model.prior if c else 1 - model.prior
        for j, vote in enumerate(v):
            config = 0
            for parent in model.parents[j]:
                config = config * 3 + (v[parent] + 1 if parent >= 0 else 1)
            out *= model.rates[j, c, config, vote + 1]
        return out

    joint = np.array([[slow(v, c) for c in (0, 1)] for v in every])
    assert abs(joint.sum() - 1) < 1e-9  # a distribution over all classes and votes: no voter is its own ancestor
    assert np.allclose(np.exp(model.joint(np.array(every))), joint)
    assert np.allclose(model.posterior(np.array(every)), joint[:, 1] / joint.sum(axis=1))


def test_label_model_finds_correlations():
    y, votes, truth = correlated_votes(20_000)
    model = fit_label_model(votes, VoterParams())
    assert {frozenset((j, int(p))) for j, p in enumerate(model.parents[:3, 0]) if p >= 0} <= {frozenset(x) for x in ((0, 1), (0, 2), (1, 2))}
    assert sum(0 <= p < 3 for p in model.parents[:3, 0]) == 2 and all(p < 0 or p > 2 for p in model.parents[3:, 0])
    blind = fit_label_model(votes, VoterParams(parents=0))
    error, blind_error = (np.abs(m.posterior(votes) - truth).mean() for m in (model, blind))
    assert error < 0.05 and error < blind_error / 2
    assert np.mean((model.posterior(votes) > 0.5) == y) >= np.mean((truth > 0.5) == y) - 0.01
