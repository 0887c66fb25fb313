"""Binary BUS files: a header, then 32-byte little-endian records."""

from __future__ import annotations

import os
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = 32
COLUMNS = ("barcode", "umi", "ec", "count", "flags")


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if ":/" in path else os.path.abspath(path))
    return system.open_input_file(inner)


class BusRecords(DataSource):
    """Records of one file from byte ``start`` on, a partition for every ``chunk`` of them."""

    @classmethod
    def name(cls) -> str:
        return "bus_records"

    def schema(self) -> str:
        return "rec_ix long, barcode long, umi long, ec long, count long, flags long"

    def reader(self, schema) -> DataSourceReader:
        return BusReader(self.options["path"], *(int(self.options[k]) for k in ("start", "total", "chunk")))


class BusReader(DataSourceReader):
    BLOCK = 250_000  # records parsed at a time

    def __init__(self, path: str, start: int, total: int, chunk: int):
        self.path, self.start, self.total, self.chunk = path, start, total, chunk

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(first) for first in range(0, max(self.total, 1), self.chunk)]

    def read(self, partition: InputPartition):
        import numpy as np
        import pyarrow as pa

        kind = np.dtype([("barcode", "<u8"), ("umi", "<u8"), ("ec", "<i4"), ("count", "<u4"), ("flags", "<u4"), ("pad", "<i4")])
        end = min(partition.value + self.chunk, self.total)
        with _open(self.path) as file:
            for first in range(partition.value, end, self.BLOCK):
                data = file.read_at(RECORD * (min(first + self.BLOCK, end) - first), self.start + RECORD * first)
                r = np.frombuffer(data, kind)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(r))), *(pa.array(r[c].astype("int64")) for c in COLUMNS)], ["rec_ix", *COLUMNS])


def read_bus(spark: SparkSession, path: str, chunk_records: int = 2_000_000) -> tuple[DataFrame, int, int]:
    """((rec_ix, barcode, umi, ec, count, flags), barcode length, UMI length).

    The header is read from the file's first bytes; every task reads its own range of
    ``chunk_records``, so a file may have any size. ``path`` is one on a file system that
    pyarrow opens (shared, hdfs, s3, gs). Bytes after the last whole record are left out.
    """
    with _open(path) as file:
        head, size = file.read_at(20, 0), file.size()
    if len(head) < 20 or head[:4] != b"BUS\0":
        raise ValueError("not a BUS file")
    barcode_length, umi_length, text = struct.unpack("<III", head[8:])
    start = 20 + text
    spark.dataSource.register(BusRecords)
    options = {"start": start, "total": max(0, size - start) // RECORD, "chunk": chunk_records}
    return spark.read.format("bus_records").options(**options).load(path), barcode_length, umi_length


def parse_classes(lines: DataFrame) -> DataFrame:
    """(ec, fragment): members of equivalence classes, from "ec<TAB>f,f,..." lines."""
    cells = F.split("line", "\t")
    return lines.where("line <> ''").select(cells[0].cast("long").alias("ec"), F.explode(F.split(cells[1], ",")).alias("f")).select("ec", F.col("f").cast("long").alias("fragment"))
