import gzip
import re
import struct
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quadrel.matrix import COL, MAIN, ROW, AnnotatedMatrix
from quadrel.sources import bus, bus_dataset, storage, text
from quadrel.streaming.append import append_cells, append_stream


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    (gzip.open if path.suffix == ".gz" else open)(path, "wt").write(content)
    return str(path)


def cells(m, layer=MAIN):
    return sorted((r[ROW], r[COL], r["value"]) for r in m.layer(layer).collect())


MTX = "%%MatrixMarket matrix coordinate integer general\n%\n3 4 4\n1 1 5\n3 2 1\n2 4 7\n3 4 2\n"
GENES = "ENS1\tA\nENS2\tB\nENS3\n"
CODES = "AAAC\nAAAG\nAAAT\nAACC\n"


def test_matrix_market(spark, tmp_path):
    read = lambda name, content: text.numbered_lines(spark, write(tmp_path / name, content))
    m = text.matrix_market({"a": read("a.mtx.gz", MTX), "b": read("b.mtx", MTX)}, read("g.tsv", GENES), read("c.tsv", CODES), "s1")
    assert cells(m, "a") == [(0, 0, 5), (1, 3, 7), (2, 1, 1), (2, 3, 2)] and cells(m) == [(0, 0, 10), (1, 3, 14), (2, 1, 2), (2, 3, 4)]
    assert [(r.Accession, r.Gene) for r in m.rows.orderBy(ROW).collect()] == [("ENS1", "A"), ("ENS2", "B"), ("ENS3", "ENS3")]
    assert [r.CellID for r in m.cols.orderBy(COL).collect()] == [f"s1:{c}" for c in CODES.split()]
    assert {(r[ROW], r[COL]) for r in text.parse_matrix_market(read("t.mtx", MTX), transposed=True).collect()} == {(0, 0), (3, 1), (1, 2), (3, 2)}


def test_cellranger(spark, tmp_path):
    v3 = tmp_path / "outs/filtered_feature_bc_matrix"
    for name, content in (("matrix.mtx.gz", MTX), ("features.tsv.gz", GENES), ("barcodes.tsv.gz", CODES)):
        write(v3 / name, content)
    v2 = tmp_path / "outs/filtered_gene_bc_matrices/hg"
    for name, content in (("matrix.mtx", MTX), ("genes.tsv", GENES), ("barcodes.tsv", CODES)):
        write(v2 / name, content)
    m = text.cellranger(spark, str(tmp_path), "s")
    assert m.shape == (3, 4) and cells(m) == cells(text.cellranger(spark, str(tmp_path), "s", genome="hg"))
    assert text.cellranger(spark, str(tmp_path), "s", genome="hg").attrs == {"Genome": "hg"}
    write(tmp_path / "outs/analysis/tsne/2_components/projection.csv", "Barcode,TSNE-1,TSNE-2\nAAAC,0.5,-1\n")
    write(tmp_path / "outs/analysis/clustering/graphclust/clusters.csv", "Barcode,Cluster\nAAAC,1\nAACC,2\n")
    analysed = {r.CellID: (r.X, r.Y, r.ClusterID) for r in text.cellranger(spark, str(tmp_path), "s").cols.collect()}
    assert analysed == {"s:AAAC": (0.5, -1.0, 0), "s:AAAG": (None, None, None), "s:AAAT": (None, None, None), "s:AACC": (None, None, 1)}
    few = text.cellranger(spark, str(tmp_path), "s", selected=["s:AACC"])
    assert few.shape == (3, 1) and cells(few) == [(1, 0, 7), (2, 0, 2)]
    m = text.with_projection(m, spark.createDataFrame([("AAAG", "1.5", "2")], "b string, x string, y string"), "s")
    m = text.with_clusters(m, spark.createDataFrame([("AAAG", "3")], "b string, c string"), "s")
    got = {r.CellID: (r.X, r.Y, r.ClusterID) for r in m.cols.collect()}
    assert got["s:AAAG"] == (1.5, 2.0, 2) and got["s:AAAC"] == (None, None, None)


@pytest.mark.parametrize("head", ['"c1"\tc2', 'gene\t"c1"\tc2'])
def test_expression_table(spark, tmp_path, head):
    lines = text.numbered_lines(spark, write(tmp_path / "x.tsv", head + '\n"B"\t1\t0\nC\t0\t"2.5"\nX\t9\t9\n'))
    m, lost = text.expression_table(lines)
    assert (m.shape, lost) == ((3, 2), 0) and cells(m) == [(0, 0, 1), (1, 1, 2.5), (2, 0, 9), (2, 1, 9)]
    target = spark.createDataFrame([(0, "A"), (1, "C"), (2, "B")], "row_ix long, Accession string")
    meta = spark.createDataFrame([(0, "c1", 5), (1, "c2", 6)], "col_ix long, id string, age int")
    m, lost = text.expression_table(lines, target, sample_id="s", col_metadata=meta)
    assert (m.shape, lost) == ((3, 2), 1) and cells(m) == [(1, 1, 2.5), (2, 0, 1)]
    assert [(r.CellID, r.age) for r in m.cols.orderBy(COL).collect()] == [("s:c1", 5), ("s:c2", 6)]
    with pytest.raises(ValueError, match="order"):
        text.expression_table(lines, col_metadata=meta.withColumn("id", F.reverse("id")))


def test_starsolo(spark, tmp_path):
    three = "%%MatrixMarket\n%\n3 4 3\n1 1 5 1 0\n3 2 0 2 0\n2 4 7 0 3\n"
    for name, content in (("Velocyto/raw/matrix.mtx", three), ("Velocyto/raw/barcodes.tsv", CODES), ("Velocyto/raw/features.tsv", GENES), ("Gene/filtered/barcodes.tsv", "AACC\nAAAC\nGGGG\n"), ("Gene/raw/matrix.mtx", MTX), ("Gene/raw/barcodes.tsv", CODES)):
        write(tmp_path / name, content)
    m = text.starsolo(spark, str(tmp_path), "s", extra=["Gene"])
    assert [(r.CellID, r.Valid_spliced, r.BarcodeTotalUMIs) for r in m.cols.orderBy(COL).collect()] == [("s:AAAC", 1, 6), ("s:AACC", 1, 10), ("s:GGGG", 0, 0)]
    assert cells(m) == [(0, 0, 6), (1, 1, 10)] and cells(m, "Gene") == [(0, 0, 5), (1, 1, 7), (2, 1, 2)]
    every = text.starsolo(spark, str(tmp_path), "s", cell_filter="none", main="spliced")
    assert every.shape == (3, 4) and cells(every) == [(0, 0, 5), (1, 3, 7)] and "spliced" not in every.layers
    assert text.starsolo(spark, str(tmp_path), "s", cell_filter="emptydrops").n_cols == 0
    samples = write(tmp_path / "samples.tsv", "name\tage\ns\t9\n")
    gtf = write(tmp_path / "g.gtf", 'chr7\tx\tgene\t10\t20\t.\t+\t.\tgene_id "ENS2"; gene_name "B"; gene_biotype "rna";\n')
    full = text.starsolo(spark, str(tmp_path), "s", samples=samples, gtf=gtf, attrs={"Title": "t"})
    assert full.attrs == {"name": "s", "age": "9", "Title": "t"} and [(r.Accession, r.Gene, r.Chromosome, r.Start) for r in full.rows.orderBy(ROW).collect()] == [("ENS1", "A", "Un", 0), ("ENS2", "B", "chr7", 10), ("ENS3", "ENS3", "Un", 0)]
    with pytest.raises(ValueError, match="filter"):
        text.starsolo(spark, str(tmp_path), "s", cell_filter="what")


def test_gene_and_sample_metadata(spark, tmp_path):
    gtf = '#c\nchr1\tx\tgene\t10\t20\t.\t+\t.\tgene_id "E1"; gene_name "A"; gene_biotype "rna";\nchr2\tx\ttranscript\t1\t2\t.\t-\t.\tgene_id "E1"; transcript_id "T1"; gene_name "A";\nchr3\tx\tgene\t5\t6\t.\t-\t.\tgene_id "E2"; gene_name "A";\n'
    lines = text.numbered_lines(spark, write(tmp_path / "g.gtf", gtf))
    lookup = text.gene_lookup(text.parse_gtf(lines))
    assert {r.key: (r.Chromosome, r.Start, r.Biotype) for r in lookup.collect()} == {"E1": ("chr1", 10, "rna"), "E2": ("chr3", 5, "n/a"), "A": ("chr3", 5, "n/a")}
    feats = spark.createDataFrame([(0, "E2"), (1, "E9")], "row_ix long, Gene string")
    assert [tuple(r) for r in text.annotate_rows(feats, lookup, "Gene").orderBy(ROW).collect()] == [(0, "E2", "E2", "n/a", "chr3", 5, 6), (1, "E9", "E9", "n/a", "Un", 0, 0)]
    assert [tuple(r) for r in text.transcript_genes(lines).collect()] == [("T1", "E1", "A")]
    path = write(tmp_path / "s.tsv", "Name\tChemistry\na\tv2\nb\tv3\na\tv4\n")
    assert text.read_sample_metadata(spark, path, "a") == {"name": "a", "chemistry": "v4"}
    with pytest.raises(ValueError, match="no sample"):
        text.read_sample_metadata(spark, path, "z")


def test_bus_file(spark, tmp_path):
    rows = [(27 + i, i % 3, i % 2, 1, 0) for i in range(10)]
    data = struct.pack("<4sIIII", b"BUS\0", 1, 4, 3, 5) + b"hello" + b"".join(struct.pack("<QQiIIi", *r, 0) for r in rows)
    (tmp_path / "o.bus").write_bytes(data)
    rec, barcode, umi = bus.read_bus(spark, str(tmp_path / "o.bus"), chunk_records=3)
    assert (barcode, umi) == (4, 3) and sorted(tuple(r) for r in rec.collect()) == [(i, *r) for i, r in enumerate(rows)]
    assert rec.rdd.getNumPartitions() == -(-len(rows) // 3)
    (tmp_path / "none.bus").write_bytes(data[:25] + b"rest")
    assert bus.read_bus(spark, str(tmp_path / "none.bus"))[0].count() == 0
    (tmp_path / "bad.bus").write_bytes(b"XXXX" + bytes(20))
    with pytest.raises(ValueError, match="BUS"):
        bus.read_bus(spark, str(tmp_path / "bad.bus"))
    classes = bus.parse_classes(text.numbered_lines(spark, write(tmp_path / "m.ec", "0\t0\n1\t0,2\n")))
    assert sorted(tuple(r) for r in classes.collect()) == [(0, 0), (1, 0), (1, 2)]


def test_bus_folder_to_dataset(spark, tmp_path):
    code = {b: i for i, b in enumerate("ACGT")}
    bits = lambda b: sum(code[c] * 4 ** (len(b) - 1 - i) for i, c in enumerate(b))
    # Two listed barcodes; one read has a letter wrong, one no neighbour, one class two genes, one a fragment without a gene.
    reads = [("AAAA", u, 0) for u in range(6)] + [("AAAA", 0, 0), ("AAAC", 9, 1), ("CCCC", 1, 1), ("CCCC", 2, 3), ("GGTT", 1, 0), ("CCCC", 3, 2), ("CCCC", 4, 4)]
    data = struct.pack("<4sIIII", b"BUS\0", 1, 4, 3, 0) + b"".join(struct.pack("<QQiIIi", bits(b), u, e, 1, 0, 0) for b, u, e in reads)
    folder, index = tmp_path / "out", tmp_path / "ix"
    write(folder / "matrix.ec", "0\t0\n1\t1\n2\t0,2\n3\t2\n4\t3\n")
    (folder / "output.bus").write_bytes(data)
    write(folder / "transcripts.txt", "f0\nf1\nf2\nlost\n")
    write(folder / "run_info.json", '{"n_processed": 13, "call": "x"}')
    write(index / "manifest.json", '{"species": "Mus", "gene_metadata_file": "g.tab", "gene_metadata_key": "Acc", "fragments_to_genes_file": "f2g.txt", "layers": {"even": "even.txt"}}')
    write(index / "g.tab", "Acc\tGene\nE0\tA\nE1\tB\n")
    write(index / "f2g.txt", "f0\tE0\nf1\tE0\nf2\tE1\n")
    write(index / "even.txt", "f0\nf2\n")
    write(index / "10xv2_whitelist.txt", "AAAA\nCCCC\n")
    samples = write(tmp_path / "s.tsv", "name\tchemistry\ttargetnumcells\tage\nme\tv2\tmany\t7\n")
    m = bus_dataset.from_bus(spark, str(folder), str(index), samples, "me", str(tmp_path / "ds"), sims=10, most=2)
    assert [(r.CellID, r.TotalUMIs) for r in m.cols.collect()] == [("me_AAAA", 7)] and [r.Gene for r in m.rows.orderBy(ROW).collect()] == ["A", "B"]
    assert cells(m) == [(0, 0, 7)] and cells(m, "even") == [(0, 0, 6)]
    barcodes = sorted((r.barcode, r.TotalUMIs, r.AmbientPValue, r.Valid) for r in m.tables["barcodes"].collect())
    assert barcodes == [(bits("AAAA"), 7, 1.0, 1), (bits("CCCC"), 2, 1.0, 0)]
    assert m.attrs["RedundantReadFraction"] == pytest.approx(1 - 9 / 13) == m.attrs["Saturation"]
    assert {k: m.attrs[k] for k in ("SampleID", "age", "Species", "NumReadsProcessed", "KallistoCommand")} == {"SampleID": "me", "age": "7", "Species": "Mus", "NumReadsProcessed": 13, "KallistoCommand": "x"}
    before = files(tmp_path)
    storage.append(spark, str(tmp_path / "ds"), replace(m, origin=None, cols=m.cols))  # tables stay
    again = storage.connect(spark, str(tmp_path / "ds"))
    assert again.n_cols == 2 and again.tables["barcodes"].count() == 2 and before.items() < files(tmp_path).items()


def test_line_numbers_of_split_files(spark, tmp_path):
    path = write(tmp_path / "m.mtx", "%%MatrixMarket\n%\n9 4 4000\n" + "".join(f"{i % 9 + 1} {i % 4 + 1} {i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = text.numbered_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 5
        got = {r.line_no: r.line for r in lines.collect()}
        assert got == dict(enumerate(open(path).read().splitlines()))
        entries = text.parse_matrix_market(text.ordered_lines(spark, path), ordered=True)
        assert sorted((r[ROW], r[COL], r["value"]) for r in entries.collect()) == sorted((i % 9, i % 4, float(i)) for i in range(4000))
        assert "ExistingRDD" not in plan(entries)  # the file itself is read, not a copy
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def sample(spark, cols=5, start=0):
    entries = [(i, j, float(i + j + start)) for i in range(3) for j in range(cols) if (i + j) % 2]
    return AnnotatedMatrix.create(spark.createDataFrame(entries, "row_ix long, col_ix long, value double"), spark.createDataFrame([(i, f"g{i}&amp;é") for i in range(3)], "row_ix long, Gene string"), spark.createDataFrame([(j, start + j) for j in range(cols)], "col_ix long, Cell int"), {"Title": "t"})


def test_storage(spark, tmp_path):
    path = str(tmp_path / "ds")
    with pytest.raises(OSError):
        storage.connect(spark, path)
    m = sample(spark).set_layer("a b", "int").set_graph(1, "k/n".replace("/", "-"), spark.createDataFrame([(0, 1, 0.5)], "a long, b long, w double"))
    storage.save(m, path)
    before = storage.last_modified(spark, path)
    back = storage.connect(spark, path)
    assert back.shape == (3, 5) and cells(back) == cells(m) and back.layer("a b").schema["value"].dataType.simpleString() == "int"
    assert {r.Gene for r in back.rows.collect()} == {f"g{i}&amp;é" for i in range(3)} and back.graph(1, "k-n").count() == 1 and back.attrs == {"Title": "t"}
    storage.append(spark, path, sample(spark, 2, 100).set_layer("a b", "int"))
    both = storage.connect(spark, path)
    assert both.shape == (3, 7) and [r.Cell for r in both.cols.orderBy(COL).collect()] == [0, 1, 2, 3, 4, 100, 101]
    assert storage.changes_since(spark, path, before)["layers"] == ["", "a b"]
    assert storage.changes_since(spark, path, "9999") == {k: [] for k in ("row_attrs", "col_attrs", "row_graphs", "col_graphs", "layers")}
    with pytest.raises(ValueError, match="infinite"):
        storage.save(m.set_layer("bad", m.layer().withColumn("value", F.lit(float("nan")))), path)
    assert storage.compare_versions("2.0.10", "3.0.0") == -1 and storage.new(spark).shape == (0, 0)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_append_writes_the_batch_only(spark, tmp_path):
    path = str(tmp_path / "ds")
    storage.append(spark, path, sample(spark))
    first = files(tmp_path)
    storage.append(spark, path, sample(spark, 2, 100))
    second = files(tmp_path)
    assert first.items() < second.items() and sum("/layers/" in f for f in second.keys() - first.keys()) <= 2
    # An attribute of one side only is dropped, or filled where a value is given; any files stay.
    extra = sample(spark, 3, 200)
    extra = replace(extra, cols=extra.cols.drop("Cell").withColumn("Batch", F.lit("x")))
    storage.append(spark, path, extra, fill_values={"Cell": -1, "Batch": "none"})
    m = storage.connect(spark, path, full=True)
    assert [(r.Cell, r.Batch) for r in m.cols.orderBy(COL).collect()] == [(c, "none") for c in (0, 1, 2, 3, 4, 100, 101)] + [(-1, "x")] * 3
    storage.append(spark, path, sample(spark, 1, 300))
    m = storage.connect(spark, path)
    assert m.shape == (3, 11) and "Batch" not in m.cols.columns and second.items() < files(tmp_path).items()
    want = [c for n, (cols, start) in enumerate(((5, 0), (2, 100), (3, 200), (1, 300))) for c in ((i, j + (0, 5, 7, 10)[n], v) for i, j, v in cells(sample(spark, cols, start)))]
    assert cells(m) == sorted(want)
    with pytest.raises(ValueError, match="rows"):
        storage.append(spark, path, replace(sample(spark), n_rows=4))


def test_changes_by_component(spark, tmp_path):
    path = str(tmp_path / "ds")
    storage.save(sample(spark).set_layer("b", "int").set_graph(1, "k", spark.createDataFrame([(0, 1, 0.5)], "a long, b long, w double")), path)
    before, written = storage.last_modified(spark, path), files(tmp_path)
    m = storage.connect(spark, path)
    storage.save(m.set_attribute(1, "Size", F.lit(3)).set_layer("b", sample(spark).layer()).set_global("Year", 2020), path)
    changes = storage.changes_since(spark, path, before)
    assert changes == {"row_attrs": [], "col_attrs": ["Size"], "row_graphs": [], "col_graphs": [], "layers": ["b"]}
    assert storage.last_modified(spark, path, "layers/") == before < storage.last_modified(spark, path, "attrs/Year")
    assert written.items() < files(tmp_path).items()
    back = storage.connect(spark, path)
    assert cells(back) == cells(m) and {r.Size for r in back.cols.collect()} == {3} and back.graph(1, "k").count() == 1
    storage.save(back.view(None, slice(0, 2)), path)  # another matrix: all of it is written
    assert storage.connect(spark, path).shape == (3, 2) and storage.changes_since(spark, path, before)["row_attrs"] == ["Gene"]


def keyed(spark, cols, start, order):
    """A matrix whose rows stand in the given order of keys; value = 100 * key + column + start."""
    entries = [(i, j, float(100 * k + j + start)) for i, k in enumerate(order) for j in range(cols)]
    rows = [(i, f"k{k}") for i, k in enumerate(order)]
    return AnnotatedMatrix.create(spark.createDataFrame(entries, "row_ix long, col_ix long, value double"), spark.createDataFrame(rows, "row_ix long, Key string"), spark.createDataFrame([(j, start + j) for j in range(cols)], "col_ix long, Cell int"), {"Batch": str(start)})


def test_stored_add_aligns_and_leaves_files(spark, tmp_path):
    path = str(tmp_path / "ds")
    storage.add_matrix(spark, path, keyed(spark, 3, 1, [0, 1, 2]).set_graph(1, "g", spark.createDataFrame([(0, 2, 1.0)], "a long, b long, w double")), key="Key")
    first = files(tmp_path)
    other = keyed(spark, 2, 50, [2, 0, 1]).set_graph(1, "g", spark.createDataFrame([(1, 0, 2.0)], "a long, b long, w double"))
    storage.add_matrix(spark, path, other.set_layer("more", "int"), key="Key", convert_attrs=True, include_graphs=True)
    second = files(tmp_path)
    assert first.items() < second.items()
    m = storage.connect(spark, path, full=True)
    assert cells(m) == sorted((k, j + s0, float(100 * k + j + start)) for k in range(3) for s0, start, n in ((0, 1, 3), (3, 50, 2)) for j in range(n))
    assert [r.Batch for r in m.cols.orderBy(COL).collect()] == ["1"] * 3 + ["50"] * 2 and "Batch" not in m.attrs and list(m.layers) == [MAIN]
    assert sorted(tuple(r) for r in m.graph(1, "g").collect()) == [(0, 2, 1.0), (4, 3, 2.0)]
    # A third one: the attribute that the second made stays as it is in the stored columns.
    storage.add_matrix(spark, path, keyed(spark, 1, 70, [1, 0, 2]), key="Key", convert_attrs=True)
    m = storage.connect(spark, path)
    assert [r.Batch for r in m.cols.orderBy(COL).collect()] == ["1"] * 3 + ["50"] * 2 + ["70"] and second.items() < files(tmp_path).items()
    with pytest.raises(ValueError, match="one to one"):
        storage.add_matrix(spark, path, keyed(spark, 1, 0, [0, 1, 3]), key="Key")
    with pytest.raises(ValueError, match="missing"):
        storage.add_matrix(spark, path, replace(keyed(spark, 1, 0, [0, 1, 2]), layers={"x": other.layer()}), key="Key")
    made = storage.combine_selected(spark, str(tmp_path / "c"), [other, m.set_layer("x", m.layer())], [[1], slice(4, None)], key="Key")
    assert made.shape == (3, 3) and cells(made) == sorted((k, j, float(100 * k + v)) for k in range(3) for j, v in enumerate((51, 51, 70)))
    assert {c for _, c, _ in cells(made, "x")} == {1, 2} and [r.Batch for r in made.cols.orderBy(COL).collect()] == ["", "50", "70"]
    with pytest.raises(ValueError, match="several types"):
        storage.combine_selected(spark, str(tmp_path / "d"), [other, replace(m, cols=m.cols.withColumn("Cell", F.lit("x")))], key="Key")


def test_versions_not_clocks_decide(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ds")
    storage.append(spark, path, sample(spark))
    before = storage.last_modified(spark, path)
    real = storage.datetime.datetime

    class Behind(real):
        @classmethod
        def now(cls, tz=None):
            return real(2001, 1, 1, tzinfo=tz)

    monkeypatch.setattr(storage.datetime, "datetime", Behind)
    storage.append(spark, path, sample(spark, 2, 100))
    assert storage.connect(spark, path).n_cols == 7 and storage.last_modified(spark, path) > before
    assert storage.changes_since(spark, path, before)["layers"] == [""]
    # Two writers from one state: the later one begins again, and one with an old matrix is refused.
    stale = storage.connect(spark, path)
    write, raced = storage.write_meta, []

    def race(spark_, path_, meta):
        if not raced:
            raced.append(1)
            storage.append(spark, path, sample(spark, 1, 200))
        write(spark_, path_, meta)

    monkeypatch.setattr(storage, "write_meta", race)
    storage.append(spark, path, sample(spark, 3, 300))
    m = storage.connect(spark, path, full=True)
    assert m.n_cols == 11 and [r.Cell for r in m.cols.orderBy(COL).collect()] == [0, 1, 2, 3, 4, 100, 101, 200, 300, 301, 302]
    assert cells(m) == sorted((i, j + s, v) for n, start, s in ((5, 0, 0), (2, 100, 5), (1, 200, 7), (3, 300, 8)) for i, j, v in cells(sample(spark, n, start)))
    with pytest.raises(storage.Conflict):
        storage.save(stale.set_global("x", 1), path)
    monkeypatch.undo()
    # Folders of the attempt that lost are listed nowhere and go; the state stays.
    assert storage.vacuum(spark, path, hours=24) == 0 and storage.vacuum(spark, path, hours=0) >= 5 and cells(storage.connect(spark, path)) == cells(m)
    storage.compact(spark, path)
    assert cells(storage.connect(spark, path)) == cells(m) and storage.versions(spark, path)[-1] == storage.metadata(spark, path)["version"]


def test_many_appends_read_one_metadata_file(spark, tmp_path):
    path, meta = str(tmp_path / "ds"), tmp_path / "ds" / "_meta"
    batch = sample(spark, 1)
    for _ in range(12):
        storage.append(spark, path, batch)
    stamps = storage.metadata(spark, path)["modified"]
    for f in sorted(meta.glob("v*.txt"))[:-1]:
        f.write_text("{not json")  # older versions are not read
    assert storage.connect(spark, path).n_cols == 12
    assert storage.compact(spark, path) == ["layers/", "col_attrs"]
    m = storage.connect(spark, path, full=True)
    assert [len(e["parts"]) for e in (m.origin.meta["layers"][""], m.origin.meta["col_attrs"])] == [1, 1] and m.origin.meta["modified"] == stamps
    assert cells(m) == sorted((i, j, v) for j in range(12) for i, _, v in cells(batch)) and storage.compact(spark, path) == []


def test_assigned_cells_write_their_bands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BAND", 4)
    path = str(tmp_path / "ds")
    entries = spark.range(200).selectExpr("id % 5 AS row_ix", "id DIV 5 AS col_ix", "CAST(id AS DOUBLE) + 1 AS value")
    whole = AnnotatedMatrix.create(entries, spark.range(5).withColumnRenamed("id", ROW), spark.range(40).withColumnRenamed("id", COL))
    storage.save(whole, path)
    first, want = files(tmp_path), {(i, j): v for i, j, v in cells(whole)}
    set_ = lambda *new: spark.createDataFrame(list(new), "row_ix long, col_ix long, value double")
    m = storage.connect(spark, path).assign(set_((1, 9, -1.0), (0, 0, -2.0))).assign(set_((1, 9, -3.0)))
    storage.save(m, path)
    new = files(tmp_path).keys() - first.keys()
    assert {f.split("/band=")[1].split("/")[0] for f in new} == {"0", "2"} and first.items() < files(tmp_path).items()
    want |= {(1, 9): -3.0, (0, 0): -2.0}
    m = storage.connect(spark, path, full=True)
    assert {(i, j): v for i, j, v in cells(m)} == want and cells(m.view(None, slice(8, 12))) == [(i, j - 8, v) for (i, j), v in sorted(want.items()) if 8 <= j < 12]
    storage.save(m.assign(set_((4, 10, 7.0), (4, 39, 8.0))), path)
    want |= {(4, 10): 7.0, (4, 39): 8.0}
    m = storage.connect(spark, path, full=True)
    assert {(i, j): v for i, j, v in cells(m)} == want and m.origin.meta["shape"] == [5, 40]
    # A predicate's columns prune bands, too.
    part = m.sparse(None, F.col(COL).isin(17, 18))
    assert re.search(r"PartitionFilters: \[[^\]]*\(band#\d+ = 4\)", plan(part))
    assert sorted(tuple(r) for r in part.collect()) == [(i, j - 17, v) for (i, j), v in sorted(want.items()) if j in (17, 18)]
    storage.compact(spark, path)
    assert {(i, j): v for i, j, v in cells(storage.connect(spark, path))} == want


def test_assigned_blocks_are_stored_as_two_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BAND", 4)
    path = str(tmp_path / "ds")
    entries = spark.range(0, 200, 2).selectExpr("id % 5 AS row_ix", "id DIV 5 AS col_ix", "CAST(id AS DOUBLE) + 1 AS value")
    whole = AnnotatedMatrix.create(entries, spark.range(5).withColumnRenamed("id", ROW), spark.range(40).withColumnRenamed("id", COL))
    storage.save(whole, path)
    want = {(i, j): v for i, j, v in cells(whole)}
    rows = lambda new: spark.createDataFrame(list(new.items()), "row_ix long, value double")
    cols = lambda *new: spark.createDataFrame([(j,) for j in new], "col_ix long")

    def assigned(m, new, *to):
        want.update({(i, j): v for i, v in new.items() for j in to})
        return m.assign_block(rows(new), cols(*to, to[0]))

    def holds(m):
        got = cells(m)
        assert len(got) == len(want) and {(i, j): v for i, j, v in got} == want

    m = storage.connect(spark, path)
    for new, to in (({1: -1.0, 2: -2.0}, (2, 9, 10)), ({2: -3.0, 3: -4.0}, (9, 10, 30)), ({1: -5.0, 2: -6.0}, (2, 9, 10))):
        m = assigned(m, new, *to)
        holds(m)
    assert len(m.patches[MAIN].blocks) == 3  # the first is gone, of the second what two others left
    # Plain cells below a block, then the block's own cells.
    want[(4, 30)] = 8.0
    storage.save(assigned(storage.connect(spark, path).assign(spark.createDataFrame([(2, 9, 7.0), (4, 30, 8.0)], "row_ix long, col_ix long, value double")), {1: -1.0, 2: -2.0}, 2, 9), path)
    for (i, j), v in {(2, 10): None, (1, 10): None, (3, 9): None, (3, 10): None, (2, 30): None, (3, 30): None}.items():
        old = 5 * j + i + 1.0 if (5 * j + i) % 2 == 0 else v
        want.pop((i, j), None)
        want.update({} if old is None else {(i, j): old})
    m = storage.connect(spark, path, full=True)
    holds(m)
    stored = [p["folder"] for p in m.origin.meta["layers"][MAIN]["parts"] if p.get("block")]
    assert len(stored) == 1 and spark.read.parquet(f"{path}/{stored[0]}/rows").count() == 2 and spark.read.parquet(f"{path}/{stored[0]}/cols").count() == 2
    assert cells(m.view(slice(0, 2), slice(8, 12))) == [(i, j - 8, v) for (i, j), v in sorted(want.items()) if i < 2 and 8 <= j < 12]
    assert storage.vacuum(spark, path, 0) > 0
    holds(storage.connect(spark, path))
    # Over a stored block: another block, a cell, an end of the shape, one part again.
    storage.save(assigned(m, {0: 0.5, 2: 0.25}, 9, 39), path)
    holds(storage.connect(spark, path, full=True))
    want[(1, 2)] = 4.0
    storage.save(storage.connect(spark, path).assign(spark.createDataFrame([(1, 2, 4.0)], "row_ix long, col_ix long, value double")), path)
    holds(storage.connect(spark, path, full=True))
    storage.resize(spark, path, 2, 39)
    want = {(i, j): v for (i, j), v in want.items() if i < 2 and j < 39}
    holds(storage.connect(spark, path, full=True))
    storage.compact(spark, path)
    holds(storage.connect(spark, path, full=True))
    with pytest.raises(ValueError, match="NaN"):
        storage.save(storage.connect(spark, path).assign_block(rows({0: float("nan")}), cols(1)), path)
    plain = whole.assign_block(rows({0: 1.0}), cols(0, 1)).assign_block(rows({0: 2.0}), cols(1))
    assert [c for c in cells(plain) if c[0] == 0][:2] == [(0, 0, 1.0), (0, 1, 2.0)]


def test_cells_of_a_block_come_by_tiles(spark, tmp_path):
    path, n = str(tmp_path / "ds"), 40_000
    rows, cols = spark.range(300).withColumnRenamed("id", ROW), spark.range(n).withColumnRenamed("id", COL)
    storage.save(AnnotatedMatrix.create(spark.createDataFrame([(2, 7, 9.0)], "row_ix long, col_ix long, value double"), rows, cols), path)
    new = rows.where(F.col(ROW) % 5 == 1).select(ROW, (F.col(ROW) + 0.5).alias("value"))
    storage.save(storage.connect(spark, path).assign_block(new, cols.where(F.col(COL) % 2 == 1)), path)
    layer = storage.connect(spark, path).layer()
    layer.write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.count("*"), F.count_distinct(ROW, COL), F.sum("value"), F.min(F.col(COL) % 2)).first() == (30 * n + 1, 30 * n + 1, n // 2 * sum(i + 0.5 for i in range(1, 300, 5)) + 9, 1)
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < 30 * n  # a byte a cell; row by row four
    # A filter reaches the two tables; a block that was stored without runs is read.
    assert re.search(r"GreaterThanOrEqual\(row_ix,100\)", plan(layer.where("row_ix >= 100"))) and re.search(r"EqualTo\(col_ix,5\)", plan(layer.where("col_ix = 5")))
    assert layer.where("row_ix >= 100 AND col_ix = 5").count() == 40
    folder = next(p["folder"] for p in storage.metadata(spark, path)["layers"][MAIN]["parts"] if p.get("block"))
    for k in ("rows", "cols"):
        spark.read.parquet(f"{path}/{folder}/{k}").drop("run").write.parquet(str(tmp_path / "old" / k))
    old = storage.read_block(spark, str(tmp_path), {"type": "double"}, {"folder": "old", "block": True}, storage.BAND)
    assert old.select(ROW, COL, "value").exceptAll(got).isEmpty() and old.count() == 30 * n


def test_resize_is_metadata(spark, tmp_path):
    path = str(tmp_path / "ds")
    storage.save(sample(spark).set_graph(1, "g", spark.createDataFrame([(0, 1, 0.5), (1, 4, 1.0)], "a long, b long, w double")), path)
    first = files(tmp_path)
    storage.resize(spark, path, 2, 3)
    assert files(tmp_path) == first
    m = storage.connect(spark, path, full=True)
    want = [c for c in cells(sample(spark)) if c[0] < 2 and c[1] < 3]
    assert m.shape == (2, 3) and cells(m) == want and m.rows.count() == 2 and m.graph(1, "g").count() == 1
    storage.resize(spark, path, 4, 6)  # what was cut off does not come back
    m = storage.connect(spark, path, full=True)
    assert m.shape == (4, 6) and cells(m) == want and [r.Gene for r in m.rows.orderBy(ROW).collect()][2:] == ["", ""] and [r.Cell for r in m.cols.orderBy(COL).collect()] == [0, 1, 2, 0, 0, 0]
    storage.save(m.assign(spark.createDataFrame([(3, 5, 9.0)], "row_ix long, col_ix long, value double")), path)
    assert cells(storage.connect(spark, path, full=True)) == sorted([*want, (3, 5, 9.0)])
    storage.compact(spark, path)
    assert cells(storage.connect(spark, path, full=True)) == sorted([*want, (3, 5, 9.0)]) and not any("limit" in p for p in storage.metadata(spark, path)["layers"][""]["parts"])
    with pytest.raises(ValueError, match="negative"):
        storage.resize(spark, path, -1)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().toString()


def test_slices_prune_what_is_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BAND", 4)
    path = str(tmp_path / "ds")
    entries = spark.range(40).selectExpr("id % 5 AS row_ix", "id DIV 2 AS col_ix", "CAST(id AS DOUBLE) + 1 AS value")
    whole = AnnotatedMatrix.create(entries, spark.range(5).withColumnRenamed("id", ROW), spark.range(20).withColumnRenamed("id", COL))
    storage.save(whole, path)
    m = storage.connect(spark, path)
    part = m.sparse(slice(1, 3), slice(2, 7))
    shown = plan(part)
    assert "PartitionFilters: [isnotnull(band" in shown and "GreaterThanOrEqual(row_ix,1)" in shown and "Join" not in shown
    assert len(part.inputFiles()) and sorted(tuple(r) for r in part.collect()) == cells(whole.view(slice(1, 3), slice(2, 7)))
    for rows, cols in ((None, [19, 0, -2]), (slice(4, None, -2), slice(17, 3, -3)), ([2], 5), (None, slice(9, 9)), (F.col(ROW) > 2, slice(0, 8))):
        a, b = m.view(rows, cols), whole.view(rows, cols)
        assert a.shape == b.shape and cells(a) == cells(b) and sorted(tuple(r) for r in m.sparse(rows, cols).collect()) == cells(b)
    assert "band#" in plan(m.sparse(None, [19, 0])).split("PartitionFilters: [")[1].split("]")[0]
    assert [(s, v.shape) for s, v in m.scan(1, 8)] == [(0, (5, 8)), (8, (5, 8)), (16, (5, 4))]


def test_opening_runs_no_job_on_layers(spark, tmp_path):
    path = str(tmp_path / "ds")
    storage.save(sample(spark), path)
    (next((tmp_path / "ds").glob("layers/*/part=*/band=*/*.parquet"))).write_bytes(b"broken")
    assert storage.connect(spark, path).shape == (3, 5)  # the layer's files are not read
    with pytest.raises(Exception):
        storage.connect(spark, path, full=True)
    meta = tmp_path / "ds" / "_meta"
    next(meta.glob("*.txt")).write_text("{not json")
    with pytest.raises(Exception) as broken:  # a broken dataset is not taken for an absent one
        storage.append(spark, path, sample(spark))
    assert not isinstance(broken.value, FileNotFoundError) and len(list(meta.glob("*.txt"))) == 1


def test_export_and_html(spark, tmp_path):
    m = sample(spark, 3)
    storage.export(m, str(tmp_path / "out"))
    lines = [r.line for r in storage.export_lines(m).orderBy("line_no").collect()]
    assert lines == ["\tCell\t0\t1\t2\t", "Gene\t\t\t\t\t", "g0&amp;é\t\t0.0\t1.0\t0.0\t", "g1&amp;é\t\t1.0\t0.0\t3.0\t", "g2&amp;é\t\t0.0\t3.0\t0.0\t"]
    assert "\n".join(lines) + "\n" == "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    with pytest.raises(NotImplementedError):
        storage.export(m, "x", format="csv")
    page = storage.to_html(m)
    assert "g0&amp;amp;é" in page and "<td>3.0</td>" in page and "Title: <em>t</em>" in page


def test_stream_of_columns(spark, tmp_path):
    rows = spark.range(3).withColumnRenamed("id", ROW)
    source, path = tmp_path / "in", str(tmp_path / "ds")
    schema = "row_ix long, cell string, value double"
    for n, batch in enumerate(([(0, "a", 1.0), (0, "a", 2.0), (2, "b", 5.0)], [(1, "c", 7.0)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        for _ in range(2):  # the second run finds nothing new
            append_stream(spark.readStream.schema(schema).parquet(str(source)), rows, path, str(tmp_path / "cp")).awaitTermination()
    m = storage.connect(spark, path)
    assert cells(m) == [(0, 0, 3.0), (1, 2, 7.0), (2, 1, 5.0)] and [r.CellID for r in m.cols.orderBy(COL).collect()] == ["a", "b", "c"]


def test_fasta_and_intervals(spark, tmp_path, monkeypatch):
    import random

    from quadrel.operators import intervals
    from quadrel.sources import fasta

    monkeypatch.setattr(intervals, "STRETCH", 50)
    rng = random.Random(2)
    genome = {"chr1": 501, "chrX": 64, "empty": 0, "chr2": 1300}
    genome = {k: "".join(rng.choice("ACGTN") for _ in range(n)) for k, n in genome.items()}
    lines = []
    for name, letters in genome.items():
        lines.append(f">{name} some words")
        at = 0
        while at < len(letters):
            n = rng.choice([1, 7, 60])
            lines += [letters[at : at + n], ""][: rng.choice([1, 2])]
            at += n
    path = write(tmp_path / "g.fa", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pieces = fasta.read_fasta(spark, path, size=64)
        rows = pieces.collect()
        assert pieces.rdd.getNumPartitions() > 4 and all(r.at // 64 == r.bin == (r.at + len(r.letters) - 1) // 64 for r in rows)
        for name, letters in genome.items():
            assert "".join(r.letters for r in sorted(rows, key=lambda r: r["at"]) if r.chrom == name) == letters
        spans = [(i, rng.choice([*genome, "none"]), s, s + rng.randrange(0, 200), rng.choice("+-")) for i, s in enumerate(rng.choices(range(0, 1300), k=80))]
        frame = spark.createDataFrame([*spans, spans[0]], "id long, chrom string, start long, end long, strand string")
        swap = str.maketrans("ACGT", "TGCA")
        want = [genome.get(c, "")[s:e] if o == "+" else genome.get(c, "")[s:e][::-1].translate(swap) for _, c, s, e, o in [*spans, spans[0]]]
        got = intervals.interval_letters(frame, pieces, stranded=True, size=64).collect()
        assert sorted((r.id, r.sequence) for r in got) == sorted((s[0], w) for s, w in zip([*spans, spans[0]], want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    named = frame.where("end > start").withColumn("name", F.concat(F.lit("n"), F.col("id")))
    merged, got = {}, intervals.merge_stranded(named).collect()
    for r in sorted(named.collect(), key=lambda r: (r.start, r.end, r.name)):
        runs = merged.setdefault((r.chrom, r.strand), [])
        if runs and r.start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], r.end), f"{runs[-1][2]},{r.name}")
        else:
            runs.append((r.start, r.end, r.name))
    assert sorted((r.chrom, r.strand, r.start, r.end, r.names) for r in got) == sorted((*k, *x) for k, runs in merged.items() for x in runs)
    genes = text.parse_gtf(text.ordered_lines(spark, write(tmp_path / "g.gtf", 'chr1\tx\tgene\t11\t20\t.\t-\t.\tgene_id "E1"; gene_name "A";\n')))
    assert [tuple(r) for r in intervals.gene_intervals(genes).collect()] == [("chr1", 10, 20, "E1", "-")]


def test_stream_of_cells_over_batches(spark, tmp_path):
    rows = spark.range(3).withColumnRenamed("id", ROW)
    source, path = tmp_path / "in", str(tmp_path / "ds")
    schema = "row_ix long, cell string, value double, time timestamp"
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    # The cell "a" comes in three batches; "z" only moves the watermark on.
    batches = [[(0, "a", 1.0, 0), (1, "b", 5.0, 1)], [(0, "a", 2.0, 3), (2, "a", 4.0, 3)], [(1, "a", 8.0, 6)], [(0, "z", 1.0, 100)], [(0, "z", 1.0, 101)]]
    for n, batch in enumerate(batches):
        made = spark.createDataFrame([(r, c, v, at(m)) for r, c, v, m in batch], "row_ix long, cell string, value double, time string").withColumn("time", F.to_timestamp("time"))
        made.coalesce(1).write.mode("append").parquet(str(source))
        for _ in range(2):  # the second run finds nothing new
            append_cells(spark.readStream.schema(schema).parquet(str(source)), rows, path, str(tmp_path / "cp")).awaitTermination()
        if n < 3:
            with pytest.raises(FileNotFoundError):
                storage.metadata(spark, path)
    m = storage.connect(spark, path)
    names = [r.CellID for r in m.cols.orderBy(COL).collect()]
    assert names == ["a", "b"] and cells(m) == [(0, 0, 3.0), (1, 0, 8.0), (1, 1, 5.0), (2, 0, 4.0)]
