"""Runs of one letter in sequences, and the fragments around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.dna import reverse_complement


def merge_intervals(intervals: DataFrame, key: str = "id") -> DataFrame:
    """(key, start, end) with overlapping or touching intervals of a key joined."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def find_runs(sequences: DataFrame, letter: str, width: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """(key, start, end): windows of ``width`` letters of which all but one at most are
    ``letter``, joined where they overlap. Every window is tested, the last one too.

    A window's count is a difference of running counts, made inside the sequence's row, so
    sequences are not exploded to letters; windows that pass are.
    """
    letters = F.filter(F.split(F.upper(F.col(seq)), ""), lambda c: c != "")
    hits = F.transform(letters, lambda c: (c == letter.upper()).cast("int"))
    starts = F.when(F.size(hits) >= width, F.sequence(F.lit(0), F.size(hits) - width)).otherwise(F.array().cast("array<int>"))
    count = lambda i: F.aggregate(F.slice("_hits", i + 1, width), F.lit(0), lambda a, x: a + x)
    found = sequences.select(key, hits.alias("_hits"), starts.alias("_starts")).select(key, F.explode(F.filter("_starts", lambda i: count(i) >= width - 1)).alias("start"))
    return merge_intervals(found.select(key, "start", (F.col("start") + width).alias("end")), key)


def fragments_at_runs(sequences: DataFrame, width: int = 15, reach: int = 600, least: int = 90, key: str = "id", seq: str = "seq") -> DataFrame:
    """(key, kind, start, fragment): the ``reach`` letters before each A-run, the reverse
    complement of those after each T-run, and each sequence's last ``reach`` letters, of at
    least ``least`` letters."""
    base = sequences.select(key, seq)
    a = find_runs(base, "A", width, key, seq).join(base, key)
    before = a.select(key, F.lit("A").alias("kind"), F.greatest(F.col("start") - reach, F.lit(0)).alias("start"), F.expr(f"substring({seq}, greatest(start - {reach}, 0) + 1, least(start, {reach}))").alias("fragment"))
    t = find_runs(base, "T", width, key, seq).join(base, key)
    after = t.select(key, F.lit("T").alias("kind"), F.col("end").alias("start"), reverse_complement(F.expr(f"substring({seq}, end + 1, {reach})")).alias("fragment"))
    tail = base.select(key, F.lit("end").alias("kind"), F.greatest(F.length(seq) - reach, F.lit(0)).alias("start"), F.expr(f"right({seq}, {reach})").alias("fragment"))
    return before.unionByName(after).unionByName(tail).where(F.length("fragment") >= least)
