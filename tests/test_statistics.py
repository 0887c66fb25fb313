import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.functions import dna, stats
from quadrel.matrix import AnnotatedMatrix
from quadrel.operators import cells, records, sequences
from quadrel.plans import catalog, fixtures


def good_turing(freqs):
    """Simple Good-Turing in plain Python, on [(r, nr)] in order."""
    r, n = [x for x, _ in freqs], [y for _, y in freqs]
    gaps = [1] + [b - a for a, b in zip(r, r[1:])]
    z = [n[i] / ((gaps[i] + (gaps[i + 1] if i + 1 < len(r) else gaps[i])) / 2) for i in range(len(r))]
    slope = np.polyfit(np.log(r), np.log(z), 1)[0]
    total = sum(a * b for a, b in freqs)
    share, turing = [], True
    for i in range(len(r)):
        line = (1 + 1 / r[i]) ** (slope + 1)
        near = i + 1 < len(r) and r[i + 1] == r[i] + 1
        t = (r[i] + 1) / r[i] * n[i + 1] / n[i] if near else 0
        sd = (i + 2) / n[i] * math.sqrt(n[i + 1] * (1 + n[i + 1] / n[i])) if near else 1
        turing = turing and abs(line - t) * (i + 1) / sd > 1.65
        share.append(t if turing else line)
    norm = sum(s * a * b for s, (a, b) in zip(share, freqs)) / total
    return [a * s * (1 - n[0] / total) / norm for s, a in zip(share, r)], n[0] / total


def test_good_turing(spark):
    freqs = [(1, 120), (2, 40), (3, 24), (4, 13), (5, 15), (6, 5), (7, 11), (8, 2), (9, 2), (10, 1), (12, 3), (14, 2), (26, 1)]
    out, p0 = stats.simple_good_turing(spark.createDataFrame(freqs, "r long, nr long"))
    want, q0 = good_turing(freqs)
    assert p0 == pytest.approx(q0)
    assert [x.rstar for x in out.orderBy("r").collect()] == pytest.approx(want)
    counts = spark.createDataFrame([(i, r) for i, r in enumerate(r for r, n in freqs for _ in range(n))], "id long, freq long")
    shares, p0 = stats.good_turing_proportions(counts, "id")
    assert shares.agg(F.sum("pstar")).first()[0] + p0 == pytest.approx(1)
    with pytest.raises(ValueError, match="distinct"):
        stats.good_turing_proportions(counts.where("freq < 5"), "id")
    with pytest.raises(ValueError, match="slope"):
        stats.simple_good_turing(spark.createDataFrame([(1, 1), (2, 5), (3, 50)], "r long, nr long"))


def test_bh(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.9, 1.0, 0.0]
    n = len(p)
    order = np.argsort(p)[::-1]
    want = np.minimum(1, np.minimum.accumulate(n * np.array(p)[order] / np.arange(n, 0, -1)))[np.argsort(order)]
    got = [r.padj for r in stats.adjust_bh(spark.createDataFrame(list(enumerate(p)), "i long, p double")).orderBy("i").collect()]
    assert got == pytest.approx(list(want))


def test_cells_are_told_from_ambient(spark):
    rng = np.random.default_rng(4)
    ambient = 1.0 / np.arange(3, 603) ** 1.3
    ambient, other = ambient / ambient.sum(), rng.permutation(ambient / ambient.sum())
    columns = [rng.multinomial(int(rng.integers(30, 120)), ambient) for _ in range(150)] + [rng.multinomial(900, ambient) for _ in range(3)] + [rng.multinomial(int(rng.integers(900, 1500)), other) for _ in range(12)]
    entries = [(i, j, int(v)) for j, c in enumerate(columns) for i, v in enumerate(c) if v]
    m = AnnotatedMatrix.create(spark.createDataFrame(entries, "row_ix long, col_ix long, value long"), spark.range(600).withColumnRenamed("id", "row_ix"), spark.range(len(columns)).withColumnRenamed("id", "col_ix"))
    top, called = cells.call_cells(m, expected_cells=12, sims=300)
    p = {r.col_ix: r.padj for r in called.collect()}
    totals = np.array([c.sum() for c in columns])
    assert top == pytest.approx(np.percentile(totals, 100 * (165 - 24) / 165))
    assert all(p[j] == 1 for j in range(150)) and all(p[j] < 0.02 for j in range(153, 165))
    kept = records.remove_empty(m, 12, sims=300, most=10**9)
    assert kept.n_cols == sum(x < 0.01 for x in p.values()) and kept.attrs == {"AmbientUMIs": top}
    profile = spark.createDataFrame([(i, float(x)) for i, x in enumerate(ambient)], "row_ix long, p double")
    seen = {r.col_ix: r.loglk for r in cells.multinomial_loglikelihoods(m.layer(), profile).collect()}
    for j in (0, 150):
        c = columns[j]
        assert seen[j] == pytest.approx(math.lgamma(c.sum() + 1) + sum(-math.lgamma(x + 1) + x * math.log(q) for x, q in zip(c, ambient) if x))


def test_empirical_pvalues(spark):
    none, nan = None, math.nan
    seen = [(0, 5, 1.0), (1, 5, 1.0), (2, 5, 2.5), (3, 5, -9.0), (4, 5, none), (5, 5, nan), (6, 6, 0.0), (7, 7, 1.0), (8, none, 1.0)]
    drawn = [(5, 1.0)] * 3 + [(5, 0.5), (5, 2.0), (5, 2.5), (5, none), (5, nan)] + [(6, -0.0), (6, -1.0)] + [(8, 1.0)]
    args = spark.createDataFrame(seen, "col_ix long, n long, loglk double"), spark.createDataFrame(drawn, "n long, loglk double")
    out = cells.empirical_pvalues(*args)
    got = {r.col_ix: r.p for r in out.collect()}
    assert got == pytest.approx({0: 2 / 9, 1: 2 / 9, 2: 6 / 9, 3: 1 / 9, 4: 1 / 9, 5: 7 / 9, 6: 2 / 3})
    assert "collect_list" not in out._jdf.queryExecution().toString()  # a total's simulations are in no one row


def test_log_factorials(spark):
    xs = [0, 1, 2, 3, 7, 8, 20, 170, 1000, 10**6, 10**9]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", stats.lgamma1(F.col("x")).alias("y")).collect()
    for r in got:
        assert r.y == pytest.approx(math.lgamma(r.x + 1), rel=1e-11, abs=1e-11)


def test_simulations_equal_drawing_one_by_one(spark):
    p = [0.5, 0.3, 0.0, 0.2]
    profile = spark.createDataFrame(list(enumerate(p)), "row_ix long, p double")
    got = {(r.sim, r.n): r.loglk for r in cells.simulate_loglikelihoods(spark, profile, [0, 3, 40, 3, 7], 5, seed=9).collect()}
    assert set(got) == {(sim, n) for sim in range(5) for n in (0, 3, 7, 40)}
    for (sim, n), value in got.items():
        drawn = np.random.default_rng([9, sim]).choice(4, 40, p=p)[:n]
        counts = np.bincount(drawn, minlength=4)
        assert value == pytest.approx(math.lgamma(n + 1) + sum(c * math.log(q) - math.lgamma(c + 1) for c, q in zip(counts, p) if c))
    assert cells.simulate_loglikelihoods(spark, profile, [], 5).count() == 0


def test_dna_codes(spark):
    df = spark.createDataFrame([("ACGT",), ("TTTT",), ("NACG",)], "s string").select("s", dna.dna_to_twobit(F.col("s")).alias("c"))
    got = df.select("c", dna.twobit_to_dna(F.col("c"), 4).alias("back"), F.size(dna.twobit_neighbours(F.col("c"), 4)).alias("n"), dna.reverse_complement(F.col("s")).alias("rc")).collect()
    assert [tuple(r) for r in got] == [(27, "ACGT", 12, "ACGT"), (255, "TTTT", 12, "AAAA"), (6, "AACG", 12, "CGTN")]
    first = spark.range(1).select(dna.twobit_neighbours(F.lit(0).cast("long"), 2).alias("n")).first().n
    assert first == [4, 8, 12, 1, 2, 3]


def test_record_pipeline(spark):
    code = {b: i for i, b in enumerate("ACGT")}
    bits = lambda s: sum(code[c] * 4 ** (len(s) - 1 - i) for i, c in enumerate(s))
    raw = [("ACGT", 1, 0), ("ACGT", 1, 0), ("ACGA", 2, 0), ("GGGG", 1, 1), ("TTAA", 1, 0), ("ACGT", 3, 2), ("ACGT", 1, 1)]
    rec = spark.createDataFrame([(i, bits(b), u, e, 1, 0) for i, (b, u, e) in enumerate(raw)], "rec_ix long, barcode long, umi long, ec long, count long, flags long")
    genes = records.gene_of_class(spark.createDataFrame([(0, 0), (1, 1), (2, 0), (2, 1)], "ec long, fragment long"), spark.createDataFrame([(0, 0), (1, 1)], "fragment long, gene long"))
    assert {r.ec: r.gene for r in genes.collect()} == {0: 0, 1: 1, 2: -1}
    white = spark.createDataFrame([(bits("ACGT"),), (bits("GGGG"),)], "barcode long")
    out = records.deduplicate(records.correct_barcodes(records.with_genes(rec, genes), white, 4))
    got = {r.rec_ix: (r.barcode, r.valid) for r in out.collect()}
    assert got == {0: (bits("ACGT"), True), 1: (bits("ACGT"), False), 2: (bits("ACGT"), True), 3: (bits("GGGG"), True), 4: (bits("TTAA"), False), 5: (bits("ACGT"), False), 6: (bits("ACGT"), True)}
    m = records.records_matrix(out, spark.range(2).withColumnRenamed("id", "row_ix"), 4, {"one": spark.createDataFrame([(1,)], "ec long")}, "s")
    assert sorted((r.row_ix, r.col_ix, r.value) for r in m.layer().collect()) == [(0, 0, 2), (1, 0, 1), (1, 1, 1)]
    assert sorted((r.row_ix, r.col_ix, r.value) for r in m.layer("one").collect()) == [(1, 0, 1), (1, 1, 1)]
    assert sorted((r.CellID, r.TotalUMIs) for r in m.cols.collect()) == [("s_ACGT", 3), ("s_GGGG", 1)]
    assert records.saturation(out).first()[0] == pytest.approx(1 - 4 / 7)


def test_runs_and_fragments(spark):
    seqs = {1: "AAAAACAAAGT", 2: "CCAAAA", 3: "AA", 4: "", 5: "G" * 20}
    got = sequences.find_runs(spark.createDataFrame(list(seqs.items()), "id long, seq string"), "A", 4).collect()

    def slow(s):
        hits = [(i, i + 4) for i in range(len(s) - 3) if s[i : i + 4].count("A") >= 3]
        out = []
        for a, b in hits:
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [tuple(x) for x in out]

    assert sorted((r.id, r.start, r.end) for r in got) == sorted((k, a, b) for k, s in seqs.items() for a, b in slow(s))
    seq = "CG" * 10 + "A" * 6 + "CTG" * 4 + "T" * 6 + "ACCGGA"
    frag = sequences.fragments_at_runs(spark.createDataFrame([(1, seq)], "id long, seq string"), 6, 15, 3).collect()
    a, t = slow_bounds(seq, "A", 6), slow_bounds(seq, "T", 6)
    assert {(r.kind, r.fragment) for r in frag} == {("A", seq[max(0, a[0] - 15) : a[0]]), ("T", seq[t[1] : t[1] + 15][::-1].translate(str.maketrans("ACGT", "TGCA"))), ("end", seq[-15:])} - {("T", "")}


def test_merged_intervals_of_ties(spark):
    rows = [(1, 5, 8), (1, 0, 4), (1, 5, 8), (1, 5, 8), (1, 9, 12), (1, 8, 8), (2, 3, 3), (2, 3, 3)] * 50
    for parts in (1, 7):
        got = sequences.merge_intervals(spark.createDataFrame(rows, "id long, start long, end long").repartition(parts)).collect()
        assert sorted(map(tuple, got)) == [(1, 0, 4), (1, 5, 8), (1, 9, 12), (2, 3, 3)]


def slow_bounds(s, c, n):
    hits = [i for i in range(len(s) - n + 1) if s[i : i + n].count(c) >= n - 1]
    return hits[0], hits[-1] + n


def test_queries_cover_whole_tables(spark, sf_dir, tmp_path):
    orders = [(k,) for k in (0, 255, 256, 65535, 65536, 600_000, 4**16 - 1)]
    spark.createDataFrame(orders, "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, k, n) for k in (10, 2999, 3000, 3004, 5_000_000) for n in (1, 2)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    letters = {k: "".join("ACGT"[k >> 2 * i & 3] for i in reversed(range(16))) for (k,) in orders}
    assert dict(run("b01_twobit_to_dna_all")) == letters
    assert dict(run("b02_dna_to_twobit_all")) == {k: k for k in letters}
    assert dict(run("i05_reverse_complement_all")) == {k: v[::-1].translate(str.maketrans("ACGT", "TGCA")) for k, v in letters.items()}
    near = sorted((k, k ^ x << 2 * p) for k in letters for p in range(16) for x in (1, 2, 3))
    assert sorted(run("b03_neighbours_all")) == near
    assert sorted(run("w07_merge_intervals_all")) == [(1, 10, 16), (1, 2999, 3010), (1, 5_000_000, 5_000_006)]
    assert catalog.QUERIES["c07_simulate"](spark, sf_dir).select("sim").distinct().count() == 1000


def test_cells_of_lines_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    lines = fixtures.table(spark, sf_dir, "lineitem").count()
    want = sorted(map(tuple, fixtures.trade(spark, sf_dir).layer().collect()))
    monkeypatch.setattr(fixtures, "LINES", 100)
    m = fixtures.trade(spark, sf_dir, ("", "lines"))
    assert m.layer().rdd.getNumPartitions() == m.layer("lines").rdd.getNumPartitions() == -(-lines // 100)
    assert sorted(map(tuple, m.layer().collect())) == want
