"""Statistics of counts: Good-Turing smoothing, false discovery rates, log-likelihoods."""

import math
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.index import checkpointed


def frequency_of_frequencies(counts: DataFrame, count: str = "freq") -> DataFrame:
    """(r, nr): how many objects were seen r times, for r > 0."""
    return counts.where(F.col(count) > 0).groupBy(F.col(count).cast("long").alias("r")).agg(F.count("*").alias("nr"))


def averaging_transform(freqs: DataFrame) -> DataFrame:
    """(r, nr, z): nr over the mean of the gaps before and after a frequency.

    The gap before the first frequency is 1; the last one has only the gap before it. The
    window runs over the distinct frequencies, which are few.
    """
    w = Window.orderBy("r")
    before = F.coalesce(F.col("r") - F.lag("r").over(w), F.lit(1))
    after = F.lead("r").over(w) - F.col("r")
    gaps = freqs.select("r", "nr", before.alias("before"), F.coalesce(after, before).alias("after"))
    return gaps.select("r", "nr", (2.0 * F.col("nr") / (F.col("before") + F.col("after"))).alias("z"))


def simple_good_turing(freqs: DataFrame) -> tuple[DataFrame, float]:
    """((r, nr, rstar), p0): smoothed frequencies and the share of unseen objects.

    A log-linear fit gives one estimate of each frequency, its successor's count (Turing)
    another. Turing's is used up to the first frequency at which the two do not differ
    significantly; from there on the line is. Raises where the line is not steeper than -1.
    """
    z = averaging_transform(freqs)
    x, y = F.log(F.col("r").cast("double")), F.log("z")
    line = z.agg(F.regr_slope(y, x).alias("slope"), F.sum(F.col("r") * F.col("nr")).alias("n"), F.min_by("nr", "r").alias("first")).first()
    if line.n is None:
        raise ValueError("no frequencies")
    if line.slope is None or line.slope > -1:
        raise ValueError(f"the slope {line.slope} is not below -1")
    p0 = float(line["first"]) / float(line.n)
    w = Window.orderBy("r")
    r, n = F.col("r").cast("double"), F.col("nr").cast("double")
    rows = z.withColumn("at", F.row_number().over(w)).withColumn("after", F.lead("nr").over(w).cast("double")).withColumn("joined", F.coalesce(F.lead("r").over(w) == F.col("r") + 1, F.lit(False)))
    linear = F.pow(1 + 1 / r, F.lit(line.slope + 1.0))
    turing = F.when(F.col("joined"), (r + 1) / r * F.col("after") / n).otherwise(0.0)
    spread = F.when(F.col("joined"), (F.col("at") + 1) / n * F.sqrt(F.col("after") * (1 + F.col("after") / n))).otherwise(1.0)
    rows = rows.select("r", "nr", "at", linear.alias("linear"), turing.alias("turing"), (F.abs(linear - turing) * F.col("at") / spread > 1.65).alias("differs"))
    switch = rows.agg(F.min(F.when(~F.col("differs"), F.col("at")))).first()[0]
    share = F.when(F.lit(True) if switch is None else F.col("at") < switch, F.col("turing")).otherwise(F.col("linear"))
    rows = rows.select("r", "nr", share.alias("share"))
    total = rows.agg(F.sum(F.col("share") * F.col("r") * F.col("nr"))).first()[0] / float(line.n)
    return rows.select("r", "nr", (F.col("r") * F.col("share") * F.lit((1 - p0) / total)).alias("rstar")), p0


def good_turing_proportions(counts: DataFrame, key: str, count: str = "freq", least: int = 10) -> tuple[DataFrame, float]:
    """((key, pstar), p0): smoothed shares of the objects seen, which sum to 1 - p0.

    Needs ``least`` distinct frequencies.
    """
    freqs = frequency_of_frequencies(counts, count)
    if freqs.count() < least:
        raise ValueError(f"fewer than {least} distinct frequencies")
    smoothed, p0 = simple_good_turing(freqs)
    total = smoothed.agg(F.sum(F.col("nr") * F.col("rstar"))).first()[0]
    shares = smoothed.select("r", ((1 - p0) * F.col("rstar") / F.lit(total)).alias("pstar"))
    return counts.where(F.col(count) > 0).withColumn("r", F.col(count).cast("long")).join(shares, "r").select(key, "pstar"), p0


def adjust_bh(pvalues: DataFrame, p: str = "p", name: str = "padj") -> DataFrame:
    """Add Benjamini-Hochberg adjusted p-values.

    Tests with one p-value have one adjusted value, so ranks and running minima are taken
    over distinct p-values, counted before the shuffle. Those are dealt to ranges; a range's
    ranks start after the counts before it, and its minima include the least of the ranges
    after it, so no window runs over all of them.
    """
    parts = int(pvalues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = pvalues.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    ranged = checkpointed(distinct.repartitionByRange(parts, "_p").withColumn("_part", F.spark_partition_id()))
    sizes = dict(sorted(map(tuple, ranged.groupBy("_part").agg(F.sum("_c")).collect())))  # a row a range
    before = dict(zip(sizes, accumulate([0, *sizes.values()]), strict=False))
    up = Window.partitionBy("_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = _by_part(before, 0) + F.sum("_c").over(up)
    step = ranged.withColumn("_q", F.lit(float(sum(sizes.values()))) * F.col("_p") / rank)
    least = dict(sorted(map(tuple, step.groupBy("_part").agg(F.min("_q")).collect())))
    after, low = {}, 1.0
    for part in sorted(least, reverse=True):
        after[part], low = low, min(low, least[part])
    down = Window.partitionBy("_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = step.select("_p", F.least(_by_part(after, 1.0), F.min("_q").over(down)).alias(name))
    return pvalues.join(adjusted, pvalues[p] == F.col("_p")).drop("_p")


def _by_part(values: dict, other):
    """Column: the value for the range ``_part``."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.col("_part")], F.lit(other)) if pairs else F.lit(other)


def lgamma1(column):
    """log(x!) of a whole-number column, x >= 0: Stirling's series for x + 8, less the logarithm
    of the seven factors between. Within 1e-11 of the value, relative beyond 1."""
    x = column.cast("double")
    t = x + 8
    factors = (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (t * t)) / (t * t)) / (t * t)) / t
    return (t - 0.5) * F.log(t) - t + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(factors)
