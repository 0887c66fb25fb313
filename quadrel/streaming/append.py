"""Columns that arrive as a stream, appended to a dataset batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.index import positions_by
from quadrel.matrix import COL, MAIN, ROW, AnnotatedMatrix
from quadrel.sources import storage


def append_stream(records: DataFrame, rows: DataFrame, path: str, checkpoint: str, cell: str = "cell", row: str = ROW, value: str = "value", trigger: dict | None = None):
    """Start a query that sums each micro-batch of (row_ix, cell, value) to new columns.

    A cell's records must come in one batch; its name becomes the attribute CellID. A batch
    that is repeated after a failure finds its number in the dataset's globals and is skipped,
    so each batch is appended once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = storage.metadata(spark, path)["attrs"].get("LastBatch", -1)
        except FileNotFoundError:
            done = -1
        if number <= done or batch.isEmpty():
            return
        cells = positions_by(batch.select(F.col(cell).alias("CellID")).distinct(), "CellID", name=COL)
        entries = batch.groupBy(F.col(row).alias(ROW), F.col(cell).alias("CellID")).agg(F.sum(value).alias("value")).join(cells, "CellID").select(ROW, COL, "value")
        storage.append(spark, path, AnnotatedMatrix.create({MAIN: entries}, rows, cells), attrs={"LastBatch": number})

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


PARTS = "rows array<long>, values array<double>"


def append_cells(records: DataFrame, rows: DataFrame, path: str, checkpoint: str, cell: str = "cell", row: str = ROW, value: str = "value", time: str = "time", delay: str = "10 minutes", gap_seconds: int = 600, trigger: dict | None = None):
    """Start a query that gathers each cell's records over micro-batches and appends it once.

    A cell is kept in keyed state, as its sums by row, until the watermark (``delay`` behind
    the latest ``time``) is ``gap_seconds`` past its last record; then it becomes a column.
    Records later than the watermark are dropped. What one batch completes is one append,
    marked by the batch's number, so a batch repeated after a failure changes nothing.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def gather(key, batches, state):
        import pandas as pd

        sums = dict(zip(*map(list, state.get), strict=True)) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"cell": [key[0]] * len(sums), "row": list(sums), "value": list(sums.values())})
            return
        last = 0
        for pdf in batches:
            for r, v in pdf.groupby("row")["value"].sum().items():
                sums[int(r)] = sums.get(int(r), 0.0) + float(v)
            last = max(last, int(pdf["time"].max().timestamp() * 1000))
        state.update((list(sums), list(sums.values())))
        state.setTimeoutTimestamp(max(last + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        return

    clean = records.select(F.col(cell).cast("string").alias("cell"), F.col(row).cast("long").alias("row"), F.col(value).cast("double").alias("value"), F.col(time).cast("timestamp").alias("time"))
    grouped = clean.withWatermark("time", delay).groupBy("cell")
    done = grouped.applyInPandasWithState(gather, "cell string, row long, value double", PARTS, "append", GroupStateTimeout.EventTimeTimeout)
    return append_stream(done, rows, path, checkpoint, cell="cell", row="row", value="value", trigger=trigger)
