"""Gene metadata tables: chains of left joins from an annotation to its registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enriched_genes(genes: DataFrame, registries: dict[str, tuple[DataFrame, str, str]], lists: dict[str, tuple[DataFrame, str, str, str]] | None = None, members: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """The genes with columns of registries, joined lists and membership flags.

    ``registries``: name -> (table, key in genes, key in table); one row a key is kept (the
    least), all other columns are added. ``lists``: column -> (table, key in genes, key in
    table, value): its distinct values in order, joined by commas. ``members``: column ->
    (table, key in genes, key in table): True where the table has the key.
    """
    out = genes
    for name, (table, mine, theirs) in registries.items():
        new = [c for c in table.columns if c != theirs and c not in out.columns]
        one = table.groupBy(F.col(theirs).alias(f"_{name}")).agg(F.min(F.struct(*new)).alias("_r")) if new else table.select(F.col(theirs).alias(f"_{name}")).distinct()
        out = out.join(one, F.col(mine) == F.col(f"_{name}"), "left").select(*out.columns, *[F.col(f"_r.{c}").alias(c) for c in new])
    for column, (table, mine, theirs, value) in (lists or {}).items():
        gathered = table.groupBy(F.col(theirs).alias("_k")).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias(column))
        out = out.join(gathered, F.col(mine) == F.col("_k"), "left").select(*out.columns, F.coalesce(column, F.lit("")).alias(column))
    for column, (table, mine, theirs) in (members or {}).items():
        keys = table.select(F.col(theirs).alias("_k")).distinct().withColumn(column, F.lit(True))
        out = out.join(keys, F.col(mine) == F.col("_k"), "left").select(*out.columns, F.coalesce(column, F.lit(False)).alias(column))
    return out
