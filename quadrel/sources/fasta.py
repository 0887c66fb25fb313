"""FASTA files as pieces of sequence with their places.

A file's lines are read in splits of any size. What comes before a split (the record that its
first lines belong to, and how many letters of it) follows from one row a split; then every
line's letters get their place, so no record is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIN = 1 << 16  # letters of a bin
PIECES = "chrom string, bin long, at long, letters string"


def read_fasta(spark: SparkSession, path: str, size: int = BIN) -> DataFrame:
    """(chrom, bin, at, letters): pieces of every record, cut at bins of ``size`` letters; ``at``
    counts from the record's start. A record's name is its header up to the first blank.
    Blank lines, and letters before the first header, are left out."""
    lines = spark.read.text(path).select(F.spark_partition_id().alias("part"), F.trim("value").alias("line")).where("line <> ''")

    def summed(batches):
        import pyarrow as pa

        part, name, letters, seen = None, None, 0, False
        for batch in batches:
            for part, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if line.startswith(">"):
                    name, letters, seen = record_name(line), 0, True
                else:
                    letters += len(line)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name], pa.string()), pa.array([letters]), pa.array([seen])], names=["part", "name", "letters", "seen"])

    before, name, count = {}, None, 0
    for r in sorted(lines.mapInArrow(summed, "part long, name string, letters long, seen boolean").collect()):  # a row a split
        before[r.part] = (name, count)
        name, count = (r.name, r.letters) if r.seen else (name, count + r.letters)

    def placed(batches):
        import pyarrow as pa

        name, at, begun = None, 0, False
        for batch in batches:
            rows: list[tuple] = []
            for part, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun:
                    (name, at), begun = before[part], True
                if line.startswith(">"):
                    name, at = record_name(line), 0
                elif name is not None:
                    rows += cut(name, at, line, size)
                    at += len(line)
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["chrom", "bin", "at", "letters"])

    return lines.mapInArrow(placed, PIECES)


def record_name(header: str) -> str:
    return (header[1:].split() or [""])[0]


def cut(name: str, at: int, letters: str, size: int = BIN) -> list[tuple]:
    """A line's letters by bins."""
    out = []
    while letters:
        room = size - at % size
        out.append((name, at // size, at, letters[:room]))
        at, letters = at + len(letters[:room]), letters[room:]
    return out
