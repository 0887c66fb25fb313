"""Intervals on named sequences: from an annotation, merged by strand, and their letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.dna import reverse_complement
from quadrel.sources.fasta import BIN

STRETCH = 1 << 20  # positions whose intervals are merged together


def gene_intervals(genes: DataFrame) -> DataFrame:
    """(chrom, start, end, name, strand) of parsed annotation lines; starts count from 0."""
    return genes.select(F.col("Chromosome").alias("chrom"), (F.col("Start") - 1).alias("start"), F.col("End").alias("end"), F.col("Accession").alias("name"), F.col("Strand").alias("strand"))


def merge_stranded(intervals: DataFrame, keys: tuple[str, ...] = ("chrom", "strand")) -> DataFrame:
    """(keys, start, end, names): intervals of equal keys that overlap or touch as one, with
    the names joined by commas in the order of start, end and name.

    How far earlier intervals reach is carried from stretch to stretch of 1,048,576 positions,
    so a sequence's intervals are sorted by stretches and never all in one task.
    """
    keys = list(keys)
    rows = intervals.select(*keys, "start", "end", F.col("name").cast("string").alias("name")).withColumn("_band", F.floor(F.col("start") / STRETCH).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*keys, "_band").agg(F.max("end").alias("_end")).withColumn("_carried", F.max("_end").over(earlier)).drop("_end")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_band"]]
    joined = lambda a, b, *more: a.alias("a").join(b.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in more])
    inside = Window.partitionBy(*keys, "_band").orderBy("start", "end", "name")
    before = F.greatest("_carried", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = joined(rows, reach, "_carried").withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    counts = fresh.groupBy(*keys, "_band").agg(F.sum("_new").alias("_n")).withColumn("_runs", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = joined(fresh, counts, "_runs").withColumn("_run", F.col("_runs") + F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "name")))
    merged = numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), listed.alias("_all"))
    return merged.select(*keys, "start", "end", F.array_join(F.transform("_all", lambda x: x["name"]), ",").alias("names"))


def sequence_bins(pieces: DataFrame) -> DataFrame:
    """(chrom, bin, letters): pieces (chrom, bin, at, letters) put together by bins."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "letters")))
    return pieces.groupBy("chrom", "bin").agg(F.array_join(F.transform(ordered, lambda x: x["letters"]), "").alias("letters"))


def interval_letters(intervals: DataFrame, pieces: DataFrame, stranded: bool = False, size: int = BIN) -> DataFrame:
    """The intervals (any columns; chrom, start, end, strand are used) with ``sequence``, their
    letters; ``stranded``: the reverse complement on strand "-". What lies outside a sequence
    is left out; without any letter it is "". Start and end count from 0, end excluded; the
    pieces' bins have ``size`` letters.

    An interval meets the bins it lies in, by an equality join on chromosome and bin; its
    letters are put together afterwards, so neither a sequence nor a pair of every interval
    and bin is held. Repeated intervals stay repeated.
    """
    named = intervals.withColumn("_id", F.monotonically_increasing_id())
    bins = F.when(F.col("end") > F.col("start"), F.sequence(F.floor(F.col("start") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long")))
    places = named.select("_id", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.explode(bins).alias("bin"))
    first = F.greatest(F.col("start") - F.col("bin") * size, F.lit(0))
    last = F.least(F.col("end") - F.col("bin") * size, F.lit(size))
    parts = places.join(sequence_bins(pieces), ["chrom", "bin"]).select("_id", "bin", F.substring("letters", (first + 1).cast("int"), (last - first).cast("int")).alias("letters"))
    whole = parts.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "letters"))), lambda x: x["letters"]), "").alias("sequence"))
    out = named.join(whole, "_id", "left").withColumn("sequence", F.coalesce("sequence", F.lit("")))
    if stranded:
        out = out.withColumn("sequence", F.when(F.col("strand") == "-", reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))
    return out.select(*intervals.columns, "sequence")
