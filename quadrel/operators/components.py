"""Principal components of columns, fitted in one pass over dense tiles.

Each task adds up the products of its columns' tiles; the partial products are summed in two
levels, and the eigenvectors of their sum, which is as large as the square of the number of
rows (features), are found on the driver. Choose features first: ``most`` bounds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.arrow import dense_tiles
from quadrel.matrix import COL, MAIN, ROW, AnnotatedMatrix

MOST = 4096  # features; their products take 128 MB in a task and on the driver
BLOCK = 64  # rows of products that travel together
TILE = 1 << 20


def column_tiles(matrix: AnnotatedMatrix, layer: str) -> DataFrame:
    """Non-zero entries, a column's together and sorted, for ``dense_tiles``."""
    entries = matrix.layer(layer).where("value <> 0").select(F.lit(0).alias("grp"), F.col(COL).cast("long").alias(COL), F.col(ROW).cast("long").alias(ROW), F.col("value").cast("double").alias("value"))
    return entries.repartition(COL).sortWithinPartitions(COL, ROW)


def refuse_many(n: int, most: int) -> None:
    if n > most:
        raise ValueError(f"{n} features; choose at most {most}")


def summed_products(matrix: AnnotatedMatrix, layer: str = MAIN, mean=None, most: int = MOST) -> tuple:
    """(sum over all columns of x x', with x less ``mean`` if given) as a numpy array."""
    import numpy as np

    n = matrix.n_rows
    refuse_many(n, most)
    center = np.zeros(n) if mean is None else mean

    def products(batches):
        import pyarrow as pa

        total, seen = np.zeros((n, n)), 0
        for _, columns, tile in dense_tiles(batches, "grp", COL, ROW, "value", n, TILE):
            tile -= center
            total += tile.T @ tile
            seen += len(columns)
        if seen:
            starts = range(0, n, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([seen] * len(starts), pa.int64()), pa.array([total[i : i + BLOCK].tobytes() for i in starts], pa.binary())], names=["block", "seen", "sums"])

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"block": [table.column("block")[0].as_py()], "seen": [sum(table.column("seen").to_pylist())], "sums": [total.tobytes()]})

    kind = "block long, seen long, sums binary"
    parts = column_tiles(matrix, layer).mapInArrow(products, kind)
    ways = max(1, int(int(matrix.spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    first = parts.withColumn("way", F.spark_partition_id() % ways).groupBy("block", "way").applyInArrow(add, kind)
    out, seen = np.zeros((n, n)), 0
    for r in first.groupBy("block").applyInArrow(add, kind).toLocalIterator():
        rows = np.frombuffer(r.sums).reshape(-1, n)
        out[r.block : r.block + len(rows)] = rows
        seen = r.seen
    return out + (matrix.n_cols - seen) * np.outer(center, center)  # columns of zeros alone


def gram_matrix(matrix: AnnotatedMatrix, layer: str = MAIN, most: int = MOST) -> DataFrame:
    """(i, j, value) of the rows' products over all columns (i <= j), those that are not 0.

    Of more than ``most`` rows the pairs that share a column are joined instead: work per
    column is then the square of its non-zero rows.
    """
    import numpy as np

    if matrix.n_rows > most:
        e = matrix.layer(layer).where("value <> 0")
        a = e.select(COL, F.col(ROW).alias("i"), F.col("value").alias("x"))
        b = e.select(COL, F.col(ROW).alias("j"), F.col("value").alias("y"))
        return a.join(b, COL).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
    import pyarrow as pa

    total = np.triu(summed_products(matrix, layer, most=most))
    i, j = np.nonzero(total)
    return matrix.spark.createDataFrame(pa.table({"i": i.astype(np.int64), "j": j.astype(np.int64), "value": total[i, j]}))


@dataclass
class Components:
    """``vectors`` (k x features, rows of length 1, largest entry positive), the ``variances``
    of the columns along them (n - 1 in the denominator), largest first, and the ``mean``."""

    mean: object
    vectors: object
    variances: object
    layer: str = MAIN

    def project(self, matrix: AnnotatedMatrix) -> DataFrame:
        """(col_ix, scores): every column's places along the components; no second fit."""
        import numpy as np

        n, mean, vectors = matrix.n_rows, self.mean, self.vectors

        def run(batches):
            import pyarrow as pa

            for _, columns, tile in dense_tiles(batches, "grp", COL, ROW, "value", n, TILE):
                scores = (tile - mean) @ vectors.T
                flat = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), scores.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(columns), flat], names=[COL, "scores"])

        found = column_tiles(matrix, self.layer).mapInArrow(run, f"{COL} long, scores array<double>")
        blank = F.array(*[F.lit(float(x)) for x in -np.asarray(mean) @ vectors.T])
        return matrix.cols.select(F.col(COL).cast("long").alias(COL)).join(found, COL, "left").select(COL, F.coalesce("scores", blank).alias("scores"))


def fit_components(matrix: AnnotatedMatrix, k: int, layer: str = MAIN, most: int = MOST) -> Components:
    """The first ``k`` principal components of the matrix's columns, zeros counted.

    Two passes: means of the rows, then products of the centred columns, so that large means
    cost no digits. Needs two columns at least.
    """
    import numpy as np

    n, columns = matrix.shape
    refuse_many(n, most)
    if columns < 2 or not 0 < k <= n:
        raise ValueError("needs two columns and 0 < k <= features")
    mean = np.zeros(n)
    for r in matrix.layer(layer).groupBy(ROW).agg(F.sum(F.col("value").cast("double")).alias("s")).collect():  # a row a feature
        mean[r[ROW]] = r.s / columns
    values, vectors = np.linalg.eigh(summed_products(matrix, layer, mean, most) / (columns - 1))
    first = np.argsort(values)[::-1][:k]
    chosen = vectors[:, first].T
    signs = np.sign(chosen[np.arange(k), np.abs(chosen).argmax(axis=1)])
    return Components(mean, chosen * signs[:, None], np.maximum(values[first], 0.0), layer)
