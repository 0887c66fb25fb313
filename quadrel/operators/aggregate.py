"""Grouped aggregates of a layer that count the zeros a coordinate table leaves out.

With ``every``, results hold a row for every row and group. Without, they hold the pairs
with a non-zero value; what is absent has the aggregate of zeros alone (0, or the group's
size for "len").
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.arrow import dense_tiles, of_rows
from quadrel.functions.index import positions_by, ranks_within
from quadrel.matrix import COL, MAIN, ROW, AnnotatedMatrix, axis_names

FUNCTIONS = "sum prod mean var std min max median first last argmin argmax len count_nonzero any all sumofsquares".split()


def groups_of(matrix: AnnotatedMatrix, group_by: str | DataFrame) -> DataFrame:
    """(col_ix, grp): a column attribute, or a table (col_ix, grp), as long labels."""
    source = matrix.cols.select(COL, F.col(group_by).alias("grp")) if isinstance(group_by, str) else group_by.select(COL, "grp")
    return source.select(COL, F.col("grp").cast("long").alias("grp"))


def aggregate(matrix: AnnotatedMatrix, group_by: str | DataFrame, how: str | list[str] = "mean", layer: str = MAIN, every: bool = False) -> DataFrame:
    """(row_ix, grp, one column per function), over the columns of every group; ``every``:
    for pairs whose values are all zero, too.

    One shuffle of partial aggregates serves all functions but the median and positions. The
    variance merges the non-zero values' with the zeros' (both exact), so nothing cancels.
    """
    wanted = [how] if isinstance(how, str) else list(how)
    unknown = set(wanted) - set(FUNCTIONS)
    if unknown:
        raise ValueError(f"unknown functions {sorted(unknown)}")
    groups = groups_of(matrix, group_by)
    # Group sizes join the columns, not the result: that would shuffle it by a few groups.
    sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    entries = matrix.layer(layer).where("value <> 0").join(sized, COL).withColumn("value", F.col("value").cast("double"))
    keys = [ROW, "grp"]
    v, n, nnz = F.col("value"), F.col("n"), F.col("nnz")
    stats = entries.groupBy(*keys).agg(
        F.max("n").alias("n"), F.count("*").alias("nnz"), F.sum(v).alias("total"), F.var_pop(v).alias("v"), F.min(v).alias("low"), F.max(v).alias("high"), F.product(v).alias("product"), F.sum(v * v).alias("squares")
    )
    zeros = n > nnz
    average = F.col("total") / nnz
    variance = (nnz * F.col("v") + average * average * nnz * (n - nnz) / n) / n
    made: dict[str, Column] = {
        "sum": F.col("total"),
        "prod": F.when(zeros, F.lit(0.0)).otherwise(F.col("product")),
        "mean": F.col("total") / n,
        "var": variance,
        "std": F.sqrt(variance),
        "min": F.when(zeros, F.least("low", F.lit(0.0))).otherwise(F.col("low")),
        "max": F.when(zeros, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")),
        "len": n,
        "count_nonzero": nnz,
        "any": nnz > 0,
        "all": ~zeros,
        "sumofsquares": F.col("squares"),
    }
    if "median" in wanted:
        filled = entries.select(*keys, "value", F.lit(1).cast("long").alias("times")).unionByName(stats.where(zeros).select(*keys, F.lit(0.0).alias("value"), (n - nnz).cast("long").alias("times")))
        stats = stats.join(filled.groupBy(*keys).agg(F.percentile("value", 0.5, F.col("times")).alias("mid")), keys)
        made["median"] = F.col("mid")
    if set(wanted) & {"first", "last", "argmin", "argmax"}:
        placed = entries.select(ROW, COL, "grp", "value").join(ranks_within(groups, "grp", COL, "at"), [COL, "grp"])
        position = placed.groupBy(*keys).agg(
            F.min_by("value", "at").alias("v0"), F.min("at").alias("a0"), F.max_by("value", "at").alias("v1"), F.max("at").alias("a1"),
            F.min(F.struct(F.col("value"), F.col("at"))).alias("lo"), F.min(F.struct((-F.col("value")).alias("m"), F.col("at"))).alias("hi"),
        )
        if set(wanted) & {"argmin", "argmax"}:
            position = position.join(first_gaps(placed, keys), keys)
        stats = stats.join(position, keys)
        zero_at = F.col("gap")
        made["first"] = F.when(F.col("a0") == 0, F.col("v0")).otherwise(F.lit(0.0))
        made["last"] = F.when(F.col("a1") == n - 1, F.col("v1")).otherwise(F.lit(0.0))
        made["argmin"] = F.when(zeros & (F.col("low") > 0), zero_at).otherwise(F.col("lo.at")).cast("long")
        made["argmax"] = F.when(zeros & (F.col("high") < 0), zero_at).otherwise(F.col("hi.at")).cast("long")
    out = stats.select(*keys, *[made[f].alias(f) for f in wanted])
    if not every:
        return out
    zero = {f: F.lit(0.0) for f in FUNCTIONS} | {f: F.lit(0).cast("long") for f in ("count_nonzero", "argmin", "argmax")} | {"any": F.lit(False), "all": F.lit(False), "len": F.col("_n")}
    return grid(matrix, groups).join(out, keys, "left").select(*keys, *[F.coalesce(f, zero[f]).alias(f) for f in wanted])


STRETCH = 4096  # places that are looked through together


def first_gaps(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap): the least place (``at``, from 0) that no row of the keys has.

    Places are ranked within stretches of 4,096, then the stretches among each other, so a
    row with all the columns of a large group is no sort of them all.
    """
    stretch = F.floor(F.col("at") / STRETCH).cast("long")
    inner = Window.partitionBy(*keys, "_stretch").orderBy("at")
    ranked = placed.select(*keys, "at", stretch.alias("_stretch")).withColumn("_k", F.col("_stretch") * STRETCH + F.row_number().over(inner) - 1)
    filled = ranked.groupBy(*keys, "_stretch").agg(F.coalesce(F.min(F.when(F.col("at") != F.col("_k"), F.col("_k"))), F.max("_k") + 1).alias("_free"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_stretch")) - 1
    # The first stretch that is missing or not full has the gap.
    numbered = filled.withColumn("_number", number)
    end = (F.col("_number") + 1) * STRETCH
    free = F.when(F.col("_stretch") != F.col("_number"), F.col("_number") * STRETCH).when(F.col("_free") < end, F.col("_free"))
    return numbered.groupBy(*keys).agg(F.coalesce(F.min(free), F.max(end)).alias("gap"))


def grid(matrix: AnnotatedMatrix, groups: DataFrame) -> DataFrame:
    """(row_ix, grp, _n): every row with every group and its size. The list of groups is
    broadcast, a row a group."""
    sizes = groups.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("_n"))
    return matrix.rows.select(ROW).crossJoin(F.broadcast(sizes))


def aggregate_custom(matrix: AnnotatedMatrix, group_by: str | DataFrame, fn: Callable, layer: str = MAIN, every: bool = False, vectorized: bool = False) -> DataFrame:
    """(row_ix, grp, value) of ``fn(numpy vector)`` over each row's whole group, zeros included,
    for rows and groups with a non-zero value, or for ``every`` pair; ``vectorized``: of
    ``fn(tile)``, which gives a number for each row of a dense tile of many rows. The vector of
    zeros alone is worked out once a group, so ``fn`` must give equal values for equal vectors."""
    groups = groups_of(matrix, group_by)
    sized = groups.join(groups.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    ranked = ranks_within(sized, "grp", COL, "at")
    entries = matrix.layer(layer).where("value <> 0").join(ranked, COL).where("grp IS NOT NULL")

    def run(batches):
        import pyarrow as pa

        for group, rows, tile in dense_tiles(batches, "grp", ROW, "at", "value", "n"):
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([group] * len(rows), pa.int64()), pa.array(of_rows(fn, tile, vectorized))], names=[ROW, "grp", "value"])

    dealt = entries.select(F.col(ROW).cast("long").alias(ROW), "grp", "n", "at", F.col("value").cast("double").alias("value")).repartition(ROW, "grp").sortWithinPartitions("grp", ROW)
    out = dealt.mapInArrow(run, f"{ROW} long, grp long, value double")
    if not every:
        return out

    def blank(batches):
        import numpy as np

        for pdf in batches:
            yield pdf.assign(_zero=[float(of_rows(fn, np.zeros((1, int(n))), vectorized)[0]) for n in pdf["_n"]])[["grp", "_zero"]]

    sizes = groups.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("_n"))
    zeros = F.broadcast(sizes.mapInPandas(blank, "grp long, _zero double"))
    # The value of a pair that is there may be null, so a mark tells pairs.
    found = out.withColumn("_there", F.lit(True))
    return matrix.rows.select(ROW).crossJoin(zeros).join(found, [ROW, "grp"], "left").select(ROW, "grp", F.when(F.col("_there"), F.col("value")).otherwise(F.col("_zero")).alias("value"))


def aggregate_attributes(matrix: AnnotatedMatrix, group_by: str, how: dict[str, str] | None = None, keep_constant: bool = False) -> DataFrame:
    """One row per group: grp and column attributes by "mean", "first", "mode" or "tally".

    "mode" gives a string, the least of the most frequent; "tally" a count column for each
    distinct value (name key_value, with / as - and . as _). ``keep_constant`` carries every
    other scalar attribute that has one value only in every group.
    """
    how = how or {}
    cols = matrix.cols.withColumn("grp", F.col(group_by).cast("long"))
    aggs = [F.count("*").alias("_n")]
    for name, kind in how.items():
        if kind == "mean":
            aggs.append(F.avg(name).alias(name))
        elif kind == "first":
            aggs.append(F.min_by(name, COL).alias(name))
        elif kind == "mode":
            aggs.append(F.mode(name, True).cast("string").alias(name))
        elif kind == "tally":
            for (value,) in cols.select(name).distinct().orderBy(name).collect():  # a column each
                label = f"{name}_{value}".replace("/", "-").replace(".", "_")
                aggs.append(F.count_if(F.col(name).eqNullSafe(F.lit(value))).alias(label))
        else:
            raise ValueError(f"unknown aggregate {kind!r}")
    if keep_constant:
        rest = [f.name for f in cols.schema if f.name not in {COL, "grp", *how} and not f.dataType.simpleString().startswith(("array", "map", "struct"))]
        counts = cols.groupBy("grp").agg(*[F.count_distinct(c).alias(c) for c in rest]).agg(*[F.max(c).alias(c) for c in rest]).first() if rest else {}
        aggs += [F.min_by(c, COL).alias(c) for c in rest if counts[c] == 1]
    return cols.groupBy("grp").agg(*aggs).drop("_n")


def aggregated_matrix(matrix: AnnotatedMatrix, group_by: str, how: str = "mean", attributes: dict[str, str] | None = None, keep_constant: bool = False, layer: str = MAIN, select=None) -> AnnotatedMatrix:
    """A matrix whose columns are the groups, ascending and without gaps, which can be saved.

    Its layer holds ``how`` of every row and group (zeros are left out, as in any layer), rows
    keep their attributes, columns have ``group_by``, the group's number of columns ``NCells``
    and the ``attributes`` of ``aggregate_attributes``. ``select`` chooses the columns that
    are grouped; columns of a null group are in none.
    """
    base = matrix if select is None else matrix.view(None, select)
    grouped = aggregate_attributes(base, group_by, attributes, keep_constant).where("grp IS NOT NULL")
    sizes = groups_of(base, group_by).groupBy("grp").agg(F.count("*").alias("NCells"))
    cols = positions_by(grouped.drop(group_by).join(sizes, "grp"), "grp", name=COL).withColumnRenamed("grp", group_by)
    values = aggregate(base, group_by, how, layer)
    # What a pair without non-zero values has is 0 for all but "len", which has every pair.
    if how == "len":
        values = aggregate(base, group_by, how, layer, every=True)
    link = cols.select(F.col(group_by).alias("grp"), COL)
    entries = values.join(link, "grp").select(ROW, COL, F.col(how).cast("double").alias("value")).where("value <> 0")
    return AnnotatedMatrix(base.rows, cols, {MAIN: entries}, base.n_rows, cols.count(), attrs=dict(base.attrs))


REDUCERS = ("sum", "mean", "std", "var", "min", "max", "count_nonzero")


def map_axis(matrix: AnnotatedMatrix, functions: list[str | Callable], axis: int = 0, layer: str = MAIN, selection=None, vectorized: bool = False) -> DataFrame:
    """(ix, f0, f1, ...): each function of every whole row (axis 0) or column (axis 1).

    Named reducers run natively, zeros counted. Callables get a dense numpy vector or, with
    ``vectorized``, a dense tile of many vectors, and give a number for each. They must give
    equal values for equal vectors. ``selection`` restricts the other axis, in its order.
    """
    if not isinstance(functions, (list, tuple)):
        raise ValueError("give a list of functions")
    ix, table, _ = matrix.axis(axis)
    source = matrix if selection is None else (matrix.view(None, selection) if axis == 0 else matrix.view(selection, None))
    width = source.shape[1 - axis]
    other = axis_names(1 - axis)[0]
    entries = source.layer(layer).where("value <> 0").withColumn("value", F.col("value").cast("double"))
    out = table.select(ix)
    named = [(i, f) for i, f in enumerate(functions) if isinstance(f, str)]
    if any(f not in REDUCERS for _, f in named):
        raise ValueError(f"known reducers are {REDUCERS}")
    if named:
        v, n = F.col("value"), F.lit(float(width))
        s = entries.groupBy(ix).agg(F.count("*").alias("nnz"), F.sum(v).alias("s"), F.avg(v).alias("a"), F.var_pop(v).alias("v"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        nnz, zero = F.col("nnz"), F.lit(0.0)
        variance = (nnz * F.col("v") + F.col("a") * F.col("a") * nnz * (n - nnz) / n) / n
        forms = {
            "sum": F.col("s"), "mean": F.col("s") / n, "var": variance, "std": F.sqrt(variance), "count_nonzero": nnz.cast("double"),
            "min": F.when(nnz < width, F.least("lo", zero)).otherwise(F.col("lo")), "max": F.when(nnz < width, F.greatest("hi", zero)).otherwise(F.col("hi")),
        }
        made = s.select(ix, *[forms[f].alias(f"f{i}") for i, f in named])
        out = out.join(made, ix, "left").na.fill(0.0)
    free = [(i, f) for i, f in enumerate(functions) if not isinstance(f, str)]
    if free:
        names = [f"f{i}" for i, _ in free]

        def values(tile):
            import pyarrow as pa

            return [pa.array(of_rows(f, tile, vectorized)) for _, f in free]

        def run(batches):
            import pyarrow as pa

            for _, rows, tile in dense_tiles(batches, "grp", ix, other, "value", width):
                yield pa.RecordBatch.from_arrays([pa.array(rows), *values(tile)], names=[ix, *names])

        def blank(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([True]), *values(np.zeros((1, width)))], names=["there", *names])

        fields = ", ".join(f"{n} double" for n in names)
        dealt = entries.select(F.lit(0).alias("grp"), F.col(ix).cast("long").alias(ix), F.col(other).cast("long").alias(other), "value").repartition(ix).sortWithinPartitions(ix)
        made = dealt.mapInArrow(run, f"{ix} long, {fields}").withColumn("there", F.lit(True))
        # Vectors of zeros alone have one value, worked out once; it is broadcast as one row.
        zeros = matrix.spark.range(1).mapInArrow(blank, f"there boolean, {fields}").select(*[F.col(n).alias(f"_{n}") for n in names])
        both = out.join(made, ix, "left").crossJoin(F.broadcast(zeros))
        out = both.select(*out.columns, *[F.when(F.col("there"), F.col(n)).otherwise(F.col(f"_{n}")).alias(n) for n in names])
    return out.select(ix, *[f"f{i}" for i in range(len(functions))])
