"""Stand-in matrices and record tables made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.matrix import COL, MAIN, ROW, AnnotatedMatrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES = 250_000  # order lines that one task makes cells of


def trade(spark: SparkSession, sf_dir: str, layers: tuple[str, ...] = (MAIN,)) -> AnnotatedMatrix:
    """Parts by suppliers: quantities (main), with layers "lines" and "discounted".

    The lines are dealt to as many tasks as they need, so a task's cells do not grow with the
    table, nor does what is grouped or joined of them in the same task. Lines that share a cell
    are few, so adding them up before they are dealt would save nothing.
    """
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    values = {MAIN: F.sum("l_quantity"), "lines": F.count("*").cast("double"), "discounted": F.sum(F.when(F.col("l_discount") > 0, F.col("l_quantity")).otherwise(0.0))}
    tasks = max(spark.sparkContext.defaultParallelism, -(-line.count() // LINES))  # the count reads the files' footers
    dealt = line.withColumnsRenamed({"l_partkey": ROW, "l_suppkey": COL}).repartition(tasks, ROW, COL)
    made = {k: dealt.groupBy(ROW, COL).agg(values[k].alias("value")) for k in layers}
    rows = part.select(F.col("p_partkey").alias(ROW), F.col("p_name").alias("Gene"), F.concat(F.lit("P"), F.col("p_partkey")).alias("Accession"), F.col("p_brand").alias("Brand"), F.col("p_size").alias("Size"))
    cols = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    cols = cols.select(
        F.col("s_suppkey").alias(COL), F.col("s_name").alias("CellID"), F.col("s_nationkey").alias("ClusterID"), F.col("n_name").alias("ClusterName"),
        F.col("r_regionkey").alias("RegionID"), F.col("r_name").alias("Region"), F.col("s_acctbal").alias("Balance"), (F.col("s_acctbal") > 0).cast("int").alias("Valid"),
    )
    return AnnotatedMatrix(rows, cols, made, part.count(), supplier.count(), attrs={"Title": "trade"})


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, w): suppliers that follow each other in an order's lines; a multigraph."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber IN (1, 2)")
    one, two = line.where("l_linenumber = 1"), line.where("l_linenumber = 2")
    return one.select("l_orderkey", F.col("l_suppkey").alias("a")).join(two.select("l_orderkey", F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("w")), "l_orderkey").select("a", "b", "w")


def dense(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """Embedding places by vectors."""
    e = table(spark, sf_dir, "embeddings")
    entries = e.select(F.col("vec_id").alias(COL), F.posexplode("embedding").alias(ROW, "value")).select(F.col(ROW).cast("long").alias(ROW), COL, F.col("value").cast("double").alias("value"))
    rows = spark.range(64).select(F.col("id").alias(ROW))
    return AnnotatedMatrix(rows, e.select(F.col("vec_id").alias(COL), "label"), {MAIN: entries}, 64, e.count())


def activity(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """Event types by users: counts."""
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().select((F.dense_rank().over(_by("event_type")) - 1).cast("long").alias(ROW), F.col("event_type").alias("Gene"))
    users = events.select("user_id").distinct().select((F.dense_rank().over(_by("user_id")) - 1).cast("long").alias(COL), F.col("user_id").alias("User"))
    entries = events.groupBy("event_type", "user_id").agg(F.count("*").alias("value")).join(kinds, F.col("event_type") == F.col("Gene")).join(users, F.col("user_id") == F.col("User")).select(ROW, COL, "value")
    return AnnotatedMatrix(kinds, users, {MAIN: entries}, kinds.count(), users.count())


def _by(*names: str):
    from pyspark.sql import Window

    return Window.orderBy(*names)  # over the distinct values of a small attribute


BARCODE_LENGTH = 8


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as records: barcode from the order, UMI from the line, class from the supplier."""
    line = table(spark, sf_dir, "lineitem")
    code = F.col("l_orderkey") % (4**BARCODE_LENGTH)
    rec = F.col("l_partkey") * 1000000 + F.col("l_suppkey")
    return line.select(
        rec.alias("rec_ix"), code.alias("barcode"), F.col("l_linenumber").cast("long").alias("umi"), F.col("l_suppkey").alias("ec"), F.lit(1).cast("long").alias("count"), F.lit(0).cast("long").alias("flags")
    )


def class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ec, fragment): a supplier's class has its fragment, and every seventh the next one too."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("ec"), F.explode(F.when(key % 7 == 0, F.array(key, key + 1)).otherwise(F.array(key))).alias("fragment"))


def fragment_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fragment, gene): five fragments a gene."""
    return class_members(spark, sf_dir).select("fragment").distinct().select("fragment", F.expr("fragment div 5").alias("gene"))


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes of every order whose key is divisible by 3."""
    orders = table(spark, sf_dir, "orders")
    return orders.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") % (4**BARCODE_LENGTH)).alias("barcode")).distinct()
