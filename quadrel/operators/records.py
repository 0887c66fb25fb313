"""Barcode/UMI records: repair, deduplication, counting, layers and saturation.

Records are (rec_ix, barcode, umi, ec, count, flags) with two-bit codes in longs; steps add
columns instead of changing rows in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.dna import twobit_neighbours, twobit_to_dna
from quadrel.functions.index import checkpointed, positions_by
from quadrel.operators.cells import call_cells
from quadrel.matrix import COL, ROW, AnnotatedMatrix

MULTI = -1


def gene_of_class(members: DataFrame, fragments: DataFrame) -> DataFrame:
    """(ec, gene): the one gene of all of a class's fragments, or -1 if there are several.

    ``members`` is (ec, fragment), ``fragments`` is (fragment, gene).
    """
    joined = members.join(fragments, "fragment")
    return joined.groupBy("ec").agg(F.when(F.count_distinct("gene") == 1, F.min("gene")).otherwise(F.lit(MULTI)).alias("gene"))


def with_genes(records: DataFrame, genes: DataFrame) -> DataFrame:
    """Add ``gene`` (-1: several or unknown) and ``valid`` (one gene)."""
    return records.join(genes, "ec", "left").withColumn("gene", F.coalesce("gene", F.lit(MULTI))).withColumn("valid", F.col("gene") != MULTI)


def correct_barcodes(records: DataFrame, whitelist: DataFrame | None, length: int) -> DataFrame:
    """Whitelisted barcodes stay; others become their first whitelisted neighbour at one
    letter's distance (by place from the left, then letter); records without one turn invalid.

    Only distinct unlisted barcodes are expanded to their 3 * length neighbours.
    """
    if whitelist is None:
        return records
    listed = whitelist.select("barcode").distinct()
    unlisted = records.select("barcode").distinct().join(listed, "barcode", "left_anti")
    candidates = unlisted.select(F.col("barcode").alias("old"), F.posexplode(twobit_neighbours(F.col("barcode"), length)).alias("at", "barcode"))
    repaired = candidates.join(listed, "barcode", "left_semi").groupBy("old").agg(F.min_by("barcode", "at").alias("fixed"))
    known = listed.select(F.col("barcode").alias("old"), F.col("barcode").alias("fixed")).unionByName(repaired)
    joined = records.join(known, F.col("barcode") == F.col("old"), "left")
    return joined.withColumn("valid", F.col("valid") & F.col("fixed").isNotNull()).withColumn("barcode", F.coalesce("fixed", "barcode")).drop("old", "fixed")


def deduplicate(records: DataFrame) -> DataFrame:
    """Of the valid records of one (barcode, umi, gene) the earliest stays valid."""
    rank = F.row_number().over(Window.partitionBy("barcode", "umi", "gene", "valid").orderBy("rec_ix"))
    return records.withColumn("valid", F.col("valid") & (rank == 1))


def valid_records(records: DataFrame) -> DataFrame:
    """(barcode, gene, ec, valid) of the valid records, written once: cells, the main layer and every
    further layer are counted from them, and the steps before run once."""
    return checkpointed(records.where("valid").select("barcode", "gene", "ec", "valid"))


def cell_index(records: DataFrame) -> DataFrame:
    """(barcode, col_ix): barcodes of valid records in ascending order."""
    return positions_by(records.where("valid").select("barcode").distinct(), "barcode", name=COL).select("barcode", COL)


def count_molecules(records: DataFrame, cells: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(row_ix, col_ix, value): valid records per gene and cell; with ``classes`` (ec) only
    those of the given classes."""
    rows = records.where("valid")
    if classes is not None:
        rows = rows.join(classes.select("ec").distinct(), "ec", "left_semi")
    counted = rows.groupBy("gene", "barcode").agg(F.count("*").alias("value"))
    return counted.join(cells, "barcode").select(F.col("gene").cast("long").alias(ROW), COL, "value")


def classes_with(members: DataFrame, fragments: DataFrame) -> DataFrame:
    """(ec) of classes with any of the listed fragments; layers may overlap."""
    return members.join(fragments.select("fragment"), "fragment", "left_semi").select("ec").distinct()


def saturation(records: DataFrame) -> DataFrame:
    """(saturation): the share of records that brought nothing new."""
    return records.agg((1 - F.avg(F.col("valid").cast("int"))).alias("saturation"))


def records_matrix(records: DataFrame, genes: DataFrame, length: int, layers: dict[str, DataFrame] | None = None, sample: str = "") -> AnnotatedMatrix:
    """The count matrix of deduplicated records, with CellID (sample_barcode), TotalUMIs and
    one further layer for each table of classes. ``genes`` are the row attributes."""
    records = valid_records(records)
    cells = cell_index(records)
    main = count_molecules(records, cells)
    more = {name: count_molecules(records, cells, classes) for name, classes in (layers or {}).items()}
    totals = main.groupBy(COL).agg(F.sum("value").alias("TotalUMIs"))
    cols = cells.join(totals, COL, "left").select(COL, F.concat(F.lit(f"{sample}_"), twobit_to_dna(F.col("barcode"), length)).alias("CellID"), F.coalesce("TotalUMIs", F.lit(0)).alias("TotalUMIs"))
    return AnnotatedMatrix.create({"": main, **more}, genes, cols, {"SampleID": sample})


def remove_empty(matrix: AnnotatedMatrix, expected_cells: int, sims: int = 1000, most: int = 1500, alpha: float = 0.01) -> AnnotatedMatrix:
    """Cells with an ambient p-value under ``alpha`` or more than ``most`` molecules."""
    top, called = call_cells(matrix, expected_cells, sims=sims)
    kept = called.where((F.col("padj") < alpha) | (F.col("total") > most)).select(COL)
    return matrix.view(None, kept).set_global("AmbientUMIs", top)
