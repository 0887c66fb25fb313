"""Importers of text formats. Each has a reader (paths, any compression Spark knows) and a
parser that works on a table of numbered lines (line_no from 0, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.index import starts_of
from quadrel.matrix import COL, MAIN, ROW, AnnotatedMatrix


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file; numbers ascend with the lines, but have gaps. Nothing
    is read for them: they are a row's partition and its place there."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file, numbered from 0. Lines of a file of several splits are
    counted once before (a number a split); a file of one split, as all compressed ones, has
    its numbers without that."""
    lines = ordered_lines(spark, path)
    part, local = F.shiftright("line_no", 33), F.col("line_no").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    if lines.rdd.getNumPartitions() <= 1:
        return lines
    sizes = [tuple(r) for r in lines.groupBy(part.alias("p")).count().collect()]
    return lines.select((starts_of(sizes, part) + local).alias("line_no"), "line")


def unquoted(column):
    return F.regexp_replace(column, '^"(.*)"$', "$1")


def parse_matrix_market(lines: DataFrame, transposed: bool = False, values: int = 1, ordered: bool = False) -> DataFrame:
    """(row_ix, col_ix, value...) of coordinate lines; comments and the size line are skipped.

    ``values`` > 1 reads several value columns (value, value2, ...) of one file. Where the rows
    stand in the order of the file (``ordered``), the size line is found in its first lines;
    else all line numbers are read for it.
    """
    data = lines.where(~F.startswith("line", F.lit("%"))).where(F.trim("line") != "")
    if ordered:
        first = data.select("line_no").first()
        size = first.line_no if first else None
    else:
        size = data.agg(F.min("line_no")).first()[0]
    cells = F.split(F.trim("line"), r"\s+")
    row, col = (1, 0) if transposed else (0, 1)
    names = ["value"] + [f"value{i}" for i in range(2, values + 1)]
    return data.where(F.col("line_no") > (size if size is not None else -1)).select(
        (cells[row].cast("long") - 1).alias(ROW), (cells[col].cast("long") - 1).alias(COL), *[cells[2 + i].cast("double").alias(n) for i, n in enumerate(names)]
    )


def parse_features(lines: DataFrame, ix: str = ROW, names: tuple[str, ...] = ("Accession", "Gene"), delim: str = "\t", skip_header: bool = False) -> DataFrame:
    """(ix, names...) by line number; a missing field repeats the first one."""
    first = 1 if skip_header else 0
    cells = F.split("line", delim)
    at = lambda i: F.coalesce(F.get(cells, F.lit(i)), cells[0])
    return lines.where(F.col("line_no") >= first).select((F.col("line_no") - first).alias(ix), *[at(i).alias(n) for i, n in enumerate(names)])


def cell_ids(barcodes: DataFrame, sample_id: str) -> DataFrame:
    """(col_ix, CellID) as sample:barcode, by line number."""
    return barcodes.select(F.col("line_no").alias(COL), F.concat(F.lit(f"{sample_id}:"), F.trim("line")).alias("CellID"))


def matrix_market(layers: dict[str, DataFrame], features: DataFrame, barcodes: DataFrame, sample_id: str, attrs: dict | None = None, transposed: bool = False, ordered: bool = False) -> AnnotatedMatrix:
    """From numbered lines (the layers' in the order of their files, if ``ordered``). Without a
    main layer, it is the sum of the others."""
    made = {k: parse_matrix_market(v, transposed, ordered=ordered) for k, v in layers.items()}
    if MAIN not in made:
        made[MAIN] = sum_layers(list(made.values()))
    return AnnotatedMatrix.create(made, parse_features(features), cell_ids(barcodes, sample_id), attrs)


def sum_layers(layers: list[DataFrame]) -> DataFrame:
    """Element-wise sum of coordinate tables."""
    union = layers[0].select(ROW, COL, "value")
    for more in layers[1:]:
        union = union.unionByName(more.select(ROW, COL, "value"))
    return union.groupBy(ROW, COL).agg(F.sum("value").alias("value"))


def cellranger(spark: SparkSession, folder: str, sample_id: str, genome: str | None = None, selected: list[str] | None = None, attrs: dict | None = None) -> AnnotatedMatrix:
    """A cellranger output folder: version 3 (filtered_feature_bc_matrix, compressed), or
    version 2 with ``genome``. ``selected`` keeps the given CellIDs. X and Y of its projection
    and ClusterID of its graph clusters are column attributes where the analysis is there."""
    if genome is None:
        base, ending, genes = f"{folder}/outs/filtered_feature_bc_matrix", ".gz", "features.tsv"
    else:
        base, ending, genes = f"{folder}/outs/filtered_gene_bc_matrices/{genome}", "", "genes.tsv"
    read = lambda name: numbered_lines(spark, f"{base}/{name}{ending}")
    entries = ordered_lines(spark, f"{base}/matrix.mtx{ending}")
    made = matrix_market({MAIN: entries}, read(genes), read("barcodes.tsv"), sample_id, {**({"Genome": genome} if genome else {}), **(attrs or {})}, ordered=True)
    # Where the analysis writes its tables.
    for name, add in (("tsne/2_components/projection.csv", with_projection), ("clustering/graphclust/clusters.csv", with_clusters)):
        path = f"{folder}/outs/analysis/{name}"
        if file_exists(spark, path):
            made = add(made, spark.read.csv(path, header=True), sample_id)
    return made if selected is None else made.view(None, F.col("CellID").isin(selected))


def file_exists(spark: SparkSession, path: str) -> bool:
    from quadrel.sources.storage import file_system

    fs, to_path = file_system(spark, path)
    return fs.exists(to_path(path))


def with_projection(matrix: AnnotatedMatrix, table: DataFrame, sample_id: str) -> AnnotatedMatrix:
    """Add X and Y from (barcode, x, y)."""
    points = table.select(F.concat(F.lit(f"{sample_id}:"), table.columns[0]).alias("CellID"), F.col(table.columns[1]).cast("double").alias("X"), F.col(table.columns[2]).cast("double").alias("Y"))
    return _joined(matrix, points)


def with_clusters(matrix: AnnotatedMatrix, table: DataFrame, sample_id: str) -> AnnotatedMatrix:
    """Add ClusterID from (barcode, label from 1), as label - 1."""
    labels = table.select(F.concat(F.lit(f"{sample_id}:"), table.columns[0]).alias("CellID"), (F.col(table.columns[1]).cast("long") - 1).alias("ClusterID"))
    return _joined(matrix, labels)


def _joined(matrix: AnnotatedMatrix, table: DataFrame) -> AnnotatedMatrix:
    from dataclasses import replace

    return replace(matrix, cols=matrix.cols.join(table.dropDuplicates(["CellID"]), "CellID", "left").select(*matrix.cols.columns, *[c for c in table.columns if c != "CellID"]))


def parse_expression_table(lines: DataFrame, delim: str = "\t", dtype: str = "float") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, genes (row_ix, gene), cells (col_ix, CellID)) of a genes-by-cells table.

    The header may or may not have a corner cell; enclosing quotes are stripped. Non-zero
    values become coordinates, without a wide row on the driver.
    """
    cells = F.split("line", delim)
    header = lines.where("line_no = 0")
    width = lines.where("line_no = 1").select(F.size(cells)).first()
    names = header.select(F.size(cells)).first()
    corner = 1 if names and (width is None or names[0] == width[0]) else 0
    ids = header.select(F.posexplode(cells).alias("p", "name")).where(F.col("p") >= corner).select((F.col("p") - corner).cast("long").alias(COL), unquoted(F.col("name")).alias("CellID"))
    body = lines.where("line_no > 0").where("line <> ''").select((F.col("line_no") - 1).alias(ROW), cells.alias("c"))
    genes = body.select(ROW, unquoted(F.col("c")[0]).alias("gene"))
    values = body.select(ROW, F.posexplode(F.slice("c", 2, F.size("c") - 1)).alias(COL, "v")).select(ROW, F.col(COL).cast("long").alias(COL), unquoted(F.col("v")).cast(dtype).alias("value"))
    return values.where("value <> 0"), genes, ids


def expression_table(lines: DataFrame, row_metadata: DataFrame | None = None, row_key: str = "Accession", sample_id: str = "", col_metadata: DataFrame | None = None, delim: str = "\t", dtype: str = "float", attrs: dict | None = None) -> tuple[AnnotatedMatrix, int]:
    """(matrix, number of unmatched genes) of a genes-by-cells text table.

    With ``row_metadata`` (row_ix and attributes) the rows are those of that table, in its
    order, joined by ``row_key``; genes it does not have are dropped and counted. The first
    column of ``col_metadata`` (col_ix and attributes) must hold the same ids in order.
    """
    entries, genes, ids = parse_expression_table(lines, delim, dtype)
    unmatched = 0
    rows = genes.withColumnRenamed("gene", row_key)
    if row_metadata is not None:
        match = genes.join(row_metadata.select(F.col(ROW).alias("target"), F.col(row_key).alias("gene")), "gene")
        unmatched = genes.join(row_metadata.select(F.col(row_key).alias("gene")), "gene", "left_anti").count()
        entries = entries.join(match.select(ROW, "target"), ROW).select(F.col("target").alias(ROW), COL, "value")
        rows = row_metadata
    cols = ids
    if col_metadata is not None:
        key = next(c for c in col_metadata.columns if c != COL)
        agreed = ids.join(col_metadata.select(COL, F.col(key).alias("_id")), COL, "full").where("CellID IS NULL OR _id IS NULL OR CellID <> _id")
        if not agreed.isEmpty():
            raise ValueError("column metadata is not in the order of the table")
        cols = ids.join(col_metadata.drop(key), COL)
    if sample_id:
        cols = cols.withColumn("CellID", F.concat(F.lit(f"{sample_id}:"), F.col("CellID")))
    return AnnotatedMatrix.create({MAIN: entries}, rows, cols, attrs, sum_duplicates=True), unmatched


def align_layers(layers: dict[str, tuple[DataFrame, DataFrame]], barcodes: DataFrame, rows: DataFrame, main: list[str] | str, sample_id: str, attrs: dict | None = None) -> AnnotatedMatrix:
    """Layers with barcode tables of their own, aligned to one set of ``barcodes``.

    Each layer is (entries, (col_ix, barcode)). Cells of the set that a layer lacks are zero
    there, and Valid_<layer> says which it has. ``main`` is a layer that becomes the main one
    or a list of layers of which the main one is the sum. BarcodeTotalUMIs are main sums.
    """
    from quadrel.functions.index import positions_by

    cells = positions_by(barcodes.select("barcode").distinct(), "barcode", name=COL).select("barcode", COL)
    made, cols = {}, cells
    for name, (entries, own) in layers.items():
        link = own.select(F.col(COL).alias("old"), "barcode").join(cells, "barcode").select("old", COL)
        made[name] = entries.withColumnRenamed(COL, "old").join(link, "old").select(ROW, COL, "value")
        cols = cols.join(own.select("barcode", F.lit(1).alias(f"Valid_{name}")).distinct(), "barcode", "left").na.fill(0, [f"Valid_{name}"])
    if isinstance(main, str):
        made[MAIN] = made.pop(main)
    else:
        made[MAIN] = sum_layers([made[m] for m in main])
    totals = made[MAIN].groupBy(COL).agg(F.sum("value").alias("BarcodeTotalUMIs"))
    cols = cols.join(totals, COL, "left").na.fill(0, ["BarcodeTotalUMIs"]).withColumn("CellID", F.concat(F.lit(f"{sample_id}:"), "barcode")).drop("barcode")
    return AnnotatedMatrix.create(made, rows, cols, attrs)


def starsolo(spark: SparkSession, folder: str, sample_id: str, cell_filter: str = "star", main: str | list[str] = "velosum", extra: list[str] | None = None, expected_cells: int = 5000, attrs: dict | None = None, samples: str | None = None, gtf: str | None = None) -> AnnotatedMatrix:
    """A STARsolo folder with Velocyto (spliced, unspliced, ambiguous in one file) and, as
    ``extra``, Gene or GeneFull. ``cell_filter``: "star" (its filtered barcodes), "none" (all),
    "emptydrops" (called here on the sum of layers) or "combine" (both sets). The sample's
    row of a table ``samples`` gives globals, ``gtf`` the genes' places and kinds."""
    read = lambda path: numbered_lines(spark, f"{folder}/{path}")
    entries = lambda path, **more: parse_matrix_market(ordered_lines(spark, f"{folder}/{path}"), ordered=True, **more)
    raw = entries("Velocyto/raw/matrix.mtx", values=3)
    own = read("Velocyto/raw/barcodes.tsv").select(F.col("line_no").alias(COL), F.trim("line").alias("barcode"))
    parts = {n: (raw.select(ROW, COL, F.col(v).alias("value")).where("value <> 0"), own) for n, v in (("spliced", "value"), ("unspliced", "value2"), ("ambiguous", "value3"))}
    for name in extra or []:
        codes = read(f"{name}/raw/barcodes.tsv").select(F.col("line_no").alias(COL), F.trim("line").alias("barcode"))
        parts[name] = (entries(f"{name}/raw/matrix.mtx"), codes)
    rows = parse_features(read("Velocyto/raw/features.tsv"))
    if gtf is not None:
        rows = rows_from_gtf(spark, gtf, rows, "Accession")
    attrs = {**(read_sample_metadata(spark, samples, sample_id) if samples else {}), **(attrs or {})}
    main = ["spliced", "unspliced", "ambiguous"] if main == "velosum" else main
    chosen = None
    if cell_filter in ("star", "combine"):
        chosen = read("Gene/filtered/barcodes.tsv").select(F.trim("line").alias("barcode"))
    if cell_filter in ("emptydrops", "combine"):
        from quadrel.operators.cells import call_cells

        everything = AnnotatedMatrix.create({MAIN: sum_layers([parts[n][0] for n in ("spliced", "unspliced", "ambiguous")])}, rows, own)
        called = call_cells(everything, expected_cells)[1].where("padj < 0.01").join(own, COL).select("barcode")
        chosen = called if chosen is None else chosen.unionByName(called).distinct()
    if cell_filter == "none":
        chosen = own.select("barcode")
    if chosen is None:
        raise ValueError(f"unknown filter {cell_filter!r}")
    return align_layers(parts, chosen, rows, main, sample_id, attrs)


# --- gene and sample metadata ----------------------------------------------------------


def parse_gtf(lines: DataFrame, feature: str = "gene") -> DataFrame:
    """(Accession, Gene, Biotype, Chromosome, Start, End, Strand, line_no) of a feature's lines."""
    cells = F.split("line", "\t")
    tag = lambda name: F.nullif(F.regexp_extract(cells[8], f'{name} "([^"]+)"', 1), F.lit(""))
    rows = lines.where(~F.startswith("line", F.lit("#"))).where(cells[2] == feature)
    return rows.select(
        tag("gene_id").alias("Accession"), tag("gene_name").alias("Gene"), F.coalesce(tag("gene_biotype"), tag("gene_type"), F.lit("n/a")).alias("Biotype"), cells[0].alias("Chromosome"),
        cells[3].cast("long").alias("Start"), cells[4].cast("long").alias("End"), cells[6].alias("Strand"), F.col("line_no"), tag("transcript_id").alias("Transcript"),
    )


def gene_lookup(genes: DataFrame) -> DataFrame:
    """(key, attributes): genes by id and by name; of a repeated key the last line counts."""
    fields = F.struct("Accession", "Gene", "Biotype", "Chromosome", "Start", "End")
    keyed = genes.select(F.col("Accession").alias("key"), "line_no", fields.alias("g")).unionByName(genes.select(F.col("Gene").alias("key"), "line_no", fields.alias("g")))
    return keyed.where("key IS NOT NULL").groupBy("key").agg(F.max_by("g", "line_no").alias("g")).select("key", "g.*")


def annotate_rows(features: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """The features (row_ix, key, ...) with annotations; unknown ones get defaults."""
    known = lookup.select(*[F.col(c).alias(f"_{c}") for c in lookup.columns])
    joined = features.join(known, F.col(key) == F.col("_key"), "left")
    new = {"Accession": F.col(key), "Biotype": F.lit("n/a"), "Chromosome": F.lit("Un"), "Start": F.lit(0), "End": F.lit(0)}
    return joined.select(*features.columns, *[F.coalesce(f"_{c}", v).alias(c) for c, v in new.items() if c not in features.columns])


def rows_from_gtf(spark: SparkSession, path: str, features: DataFrame, key: str = "Accession") -> DataFrame:
    """Features (row_ix, key, ...) with the genes' places and kinds of an annotation file."""
    return annotate_rows(features, gene_lookup(parse_gtf(ordered_lines(spark, path))), key)


def transcript_genes(lines: DataFrame) -> DataFrame:
    """(Transcript, Accession, Gene) of a GTF's transcript lines."""
    return parse_gtf(lines, "transcript").select("Transcript", "Accession", "Gene")


def sample_metadata(table: DataFrame, sample_id: str) -> dict:
    """Lower-cased attributes of the last row whose sampleid (else name) is ``sample_id``."""
    lower = table.select(F.monotonically_increasing_id().alias("_at"), *[F.col(f"`{c}`").alias(c.lower()) for c in table.columns])
    key = "sampleid" if "sampleid" in lower.columns else "name"
    found = lower.where(F.col(key) == sample_id).orderBy(F.desc("_at")).drop("_at").first()
    if found is None:
        raise ValueError(f"no sample {sample_id!r}")
    return found.asDict()


def read_sample_metadata(spark: SparkSession, path: str, sample_id: str) -> dict:
    """From a TSV file, or a table "sample" by JDBC where the path is a jdbc: address."""
    if path.startswith("jdbc:"):
        table = spark.read.format("jdbc").options(url=path, dbtable="sample").load()
    else:
        table = spark.read.csv(path, sep="\t", header=True)
    return sample_metadata(table, sample_id)
