"""Dense 0-based positions without a global window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAND = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a session that runs in one process (as in unit tests) may leave it unset and gets a
    temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder of ``shared_folder``."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def renumber(df: DataFrame, ix: str, name: str = "new_ix") -> DataFrame:
    """Add the rank of the unique integer ``ix`` among the rows of ``df``, from 0.

    Ranks are counted in bands of 65,536 numbers, and bands are offset by the sums before
    them: the only window without a partition is over one row a band.
    """
    band = F.floor(F.col(ix) / BAND).cast("long")
    banded = df.withColumn("_band", band)
    sizes = banded.groupBy("_band").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_band").orderBy(ix)
    return banded.withColumn("_rank", F.row_number().over(inner)).join(offsets, "_band").withColumn(name, F.col("_offset") + F.col("_rank") - 1).drop("_band", "_rank", "_offset")


def ranks_within(df: DataFrame, group: str, ix: str, name: str) -> DataFrame:
    """Add the rank of the integer ``ix`` among the rows of its group, from 0, as ``renumber``
    does for all rows: no group is sorted in one task."""
    banded = df.withColumn("_band", F.floor(F.col(ix) / BAND).cast("long"))
    sizes = banded.groupBy(group, "_band").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_group"), F.col("_band").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(group, "_band").orderBy(ix)
    ranked = banded.withColumn("_rank", F.row_number().over(inner))
    joined = ranked.join(offsets, ranked[group].eqNullSafe(offsets["_group"]) & (ranked["_band"] == offsets["_of"]))
    return joined.withColumn(name, F.col("_offset") + F.col("_rank") - 1).select(*df.columns, name)


def positions_by(df: DataFrame, *order: Column | str, name: str = "new_ix") -> DataFrame:
    """Add the 0-based position of every row in the order of ``order`` (make it total).

    Rows are range-partitioned and sorted; each partition's size is counted, and the few
    sizes give the partitions' offsets. The sorted rows are checkpointed first, because the
    ranges must not change between the two passes.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())  # a row a partition
    return placed.withColumn(name, starts_of(sizes, part) + local).drop("_at")


def starts_of(sizes: list[tuple[int, int]], part: Column) -> Column:
    """Rows before each partition, looked up by its number ``part``, from (number, rows) pairs.
    One array literal: a lookup is one step, however many partitions there are."""
    starts, total = [0] * (max((p for p, _ in sizes), default=0) + 1), 0
    for p, n in sorted(sizes):
        starts[p] = total
        total += n
    return F.get(F.array(*[F.lit(x).cast("long") for x in starts]), part.cast("int"))
