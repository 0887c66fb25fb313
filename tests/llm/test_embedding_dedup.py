import numpy as np
import pytest

from quadrel.llm.embedding_dedup import LADDER, LatticeParams, cells, link_embeddings, nearest_e8, unit
from quadrel.llm.queries import OP2_SQL, op2_embedding_dedup
from tests.oracle import same


def brute(rows, threshold=0.93):
    ok = [i for i, (k, e, label) in enumerate(rows) if k is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].add(j)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    found = nearest_e8(y)
    doubled = np.rint(found * 2).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1)).all() and (doubled.sum(axis=1) % 4 == 0).all()
    assert (((y - found) ** 2).sum(axis=1) <= 1 + 1e-9).all()  # the covering radius


def test_groups_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for label in range(3):
        centres = rng.normal(size=(12, 16))
        for c in centres:
            for _ in range(int(rng.integers(1, 9))):
                rows.append((k, [float(x) for x in np.float32(c + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.4]))], label))
                k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 16, 1), (k + 2, [float("nan")] * 16, 1), (k + 3, [None, *[1.0] * 15], 1), (k + 4, [1.0] * 16, None), (None, [1.0] * 16, 1), (k + 5, [], 1), (k + 6, [1.0, 2.0], 1), (k + 7, [2.0, 4.0], 1), (k + 8, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    assert result(link_embeddings(df)) == brute(rows)
    assert result(link_embeddings(df, params=LatticeParams(block=3))) == brute(rows)


def test_every_step_of_the_ladder(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(k, [float(x) for x in centres[k % 30] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.2])], k % 60 // 30) for k in range(180)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for _, params in LADDER[1:]:
        assert result(link_embeddings(df, params=params)) == brute(rows)
    # Labels of different sizes stand on different steps.
    rows += [(1000 + k, [float(x) for x in rng.normal(size=24)], 7) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr("quadrel.llm.embedding_dedup.LADDER", ((25, LADDER[0][1]), (1 << 62, LADDER[1][1])))
    monkeypatch.setattr("quadrel.llm.embedding_dedup.FEW", 1)
    assert result(link_embeddings(df)) == brute(rows)


def test_share_of_pairs_falls_and_near_pairs_meet():
    """Pairs of cosine 0.93 and random pairs in 64 dimensions, on the steps for 20,000 and
    80,000 vectors a label, and beyond."""
    rng = np.random.default_rng(0)
    shares = []
    for step, (_, params) in enumerate(LADDER[:3]):
        n = 20_000 if step < 2 else 6000
        a, z, other = (unit(rng.normal(size=(n, 64))) for _ in range(3))
        z = unit(z - (z * a).sum(axis=1, keepdims=True) * a)
        label = np.zeros(n, np.int64)
        met = lambda x, y: ((x == y[:, :, :1]).any(axis=2) | (y == x[:, :, :1]).any(axis=2)).any(axis=1).mean()
        own = cells(a, label, params)
        assert met(own, cells(0.93 * a + np.sqrt(1 - 0.93**2) * z, label, params)) >= 0.998, step
        shares.append(met(own, cells(other, label, params)))
    assert shares[0] < 0.08 and shares[1] < shares[0] / 3 and shares[2] < shares[1] / 10
    assert next(p for most, p in LADDER if 20_000 <= most) != next(p for most, p in LADDER if 80_000 <= most)


def test_empty(spark):
    assert link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    assert same(spark, f"/root/testdata/{sf}", op2_embedding_dedup, OP2_SQL)
