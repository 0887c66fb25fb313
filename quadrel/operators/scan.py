"""Bands of an axis in one pass over all layers.

The entries of every layer, tagged by its name, are dealt by bands and sorted in one shuffle.
``apply`` calls a function on each band where it lies; ``local`` brings the bands to the
driver in order, a few at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadrel.functions.arrow import whole_groups
from quadrel.functions.index import checkpointed
from quadrel.matrix import COL, ROW, AnnotatedMatrix, Selector, axis_names

CHOSEN = "/items"  # no layer has a slash in its name


@dataclass
class Band:
    """Entries of ``start`` <= position < ``start`` + ``size``. ``layers`` has for each name
    numpy arrays (position in the band, position on the other axis, value), in order; with
    items, positions count the selected ones (``items``, positions on the whole axis)."""

    start: int
    size: int
    layers: dict[str, tuple] = field(default_factory=dict)
    items: object = None


def banded_entries(matrix: AnnotatedMatrix, axis: int, batch_size: int, items: DataFrame | None) -> DataFrame:
    """(band, layer, own, other, value as double), a band's rows together and sorted."""
    ix = axis_names(axis)[0]
    other = COL if axis == 0 else ROW
    tagged = [e.select(F.lit(k).alias("layer"), F.col(ix).cast("long").alias("own"), F.col(other).cast("long").alias("other"), F.col("value").cast("double").alias("value")) for k, e in matrix.layers.items()]
    entries = reduce(DataFrame.unionByName, tagged).where("value <> 0")
    if items is not None:
        chosen = items.select(F.col(ix).cast("long").alias("own"))
        marks = chosen.select(F.lit(CHOSEN).alias("layer"), "own", F.lit(0).cast("long").alias("other"), F.lit(0.0).alias("value"))
        entries = entries.join(chosen, "own", "left_semi").unionByName(marks)
    banded = entries.withColumn("band", F.floor(F.col("own") / batch_size).cast("long"))
    n = -(-matrix.shape[axis] // batch_size)
    parts = max(1, min(n, int(matrix.spark.conf.get("spark.sql.shuffle.partitions"))))
    # Neighbouring bands lie in one partition, and partitions follow each other.
    dealt = banded.repartitionById(parts, F.floor(F.col("band") * parts / max(n, 1)).cast("int"))
    return dealt.sortWithinPartitions("band", "layer", "own", "other")


def bands_of(batches, batch_size: int, n: int) -> Iterator[Band]:
    import numpy as np

    bounds = lambda x: np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
    for table in whole_groups(batches, ["band"]):
        every = [table.column(c).to_numpy() for c in ("band", "layer", "own", "other", "value")]
        for low, high in itertools.pairwise(bounds(every[0])):
            band, names, own, other, value = (x[low:high] for x in every)
            start = int(band[0]) * batch_size
            made = Band(start, min(batch_size, n - start))
            parts = {names[a]: slice(a, b) for a, b in itertools.pairwise(bounds(names))}
            if CHOSEN in parts:
                made.items = own[parts[CHOSEN]]
            for k, part in parts.items():
                if k != CHOSEN:
                    place = own[part] - start if made.items is None else np.searchsorted(made.items, own[part])
                    made.layers[k] = (place, other[part], value[part])
            yield made


def prepared(matrix: AnnotatedMatrix, axis: int, items: Selector, layers: list[str] | None, key: str | None) -> tuple[AnnotatedMatrix, DataFrame | None]:
    """(the matrix with its other axis sorted by ``key``, the chosen positions or None)."""
    ix, table, _ = matrix.axis(axis)
    base = matrix if layers is None else replace(matrix, layers={k: matrix.layer(k) for k in layers})
    chosen = None if items is None else checkpointed(table.select(ix).join(base.selection(axis, items).select(ix), ix, "left_semi"))
    return (base if key is None else base.permute(1 - axis, key)), chosen


def apply(matrix: AnnotatedMatrix, axis: int, fn: Callable[[Band], dict], schema: str, batch_size: int = 512, items: Selector = None, layers: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Rows that ``fn`` makes of each band (a dict of equally long columns), in one job.

    Bands without a non-zero value in any layer (with ``items``: without a chosen position)
    are left out. A band's entries are in one task's memory, so choose ``batch_size`` so that
    this many rows or columns fit.
    """
    base, chosen = prepared(matrix, axis, items, layers, key)
    n, kinds = matrix.shape[axis], to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for band in bands_of(batches, batch_size, n):
            made = fn(band)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in kinds], schema=kinds)

    return banded_entries(base, axis, batch_size, chosen).mapInArrow(run, schema)


def local(matrix: AnnotatedMatrix, axis: int, batch_size: int = 512, items: Selector = None, layers: list[str] | None = None, key: str | None = None) -> Iterator[tuple[int, AnnotatedMatrix]]:
    """(first position, view) of successive bands on the driver, whose layers are there already.

    All bands and layers come from one shuffle; the next partition is fetched while one is
    worked on, so about two partitions of bands are held. Without ``items`` every band comes,
    with ``items`` those with a chosen position. Values travel as doubles.
    """
    import numpy as np
    import pyarrow as pa

    base, chosen = prepared(matrix, axis, items, layers, key)
    n, spark = matrix.shape[axis], matrix.spark

    def pack(batches):
        raw = lambda x: np.ascontiguousarray(x).tobytes()
        for band in bands_of(batches, batch_size, n):
            rows = [(k, *map(raw, arrays)) for k, arrays in band.layers.items()]
            rows += [] if band.items is None else [(CHOSEN, raw(band.items), b"", b"")]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([band.start] * len(rows), pa.int64()), pa.array(columns[0], pa.string()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["start", "layer", "own", "other", "value"])

    packed = banded_entries(base, axis, batch_size, chosen).mapInArrow(pack, "start long, layer string, own binary, other binary, value binary")
    types = {k: e.schema["value"].dataType for k, e in base.layers.items()}
    bare = replace(base, layers={}, origin=None)

    def view(start: int, rows: list) -> AnnotatedMatrix:
        part, found = slice(start, start + batch_size), {}
        for r in rows:
            if r.layer == CHOSEN:
                part = np.frombuffer(r.own, np.int64).tolist()
            else:
                own, other = np.frombuffer(r.own, np.int64), np.frombuffer(r.other, np.int64)
                row, col = (own, other) if axis == 0 else (other, own)
                found[r.layer] = spark.createDataFrame(pa.table({ROW: row, COL: col, "value": np.frombuffer(r.value)})).withColumn("value", F.col("value").cast(types[r.layer]))
        made = bare.view(part, None) if axis == 0 else bare.view(None, part)
        empty = {k: spark.createDataFrame([], f"{ROW} long, {COL} long, value {t.simpleString()}") for k, t in types.items() if k not in found}
        return replace(made, layers={k: found[k] if k in found else empty[k] for k in types})

    wanted = 0  # the next band to give, of all bands
    for start, rows in itertools.groupby(packed.toLocalIterator(prefetchPartitions=True), key=lambda r: r.start):
        if chosen is None:
            for blank in range(wanted, start, batch_size):
                yield blank, view(blank, [])
        yield start, view(start, list(rows))
        wanted = start + batch_size
    if chosen is None:
        for blank in range(wanted, n, batch_size):
            yield blank, view(blank, [])
