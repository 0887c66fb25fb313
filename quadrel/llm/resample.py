"""Importance resampling towards a target: hashed n-gram counts of two corpora.

A text is scanned once. For the last n places a feature may have started at, the running
zlib state of its bytes is kept; each word extends every state by a space and the word and
starts a new one, so that all n-grams of the word's end are hashed without being written
out. The states' buckets of a document travel as two bytes each to the second step, which
adds up the buckets' gains.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.index import checkpointed, positions_by
from quadrel.llm.decontaminate import normalised

BUCKETS = 10_000
ORDER = 3  # words of the longest feature
CHUNK = 4_096  # words between which the ring is carried over


class Ring:
    """Running states of the features that end at the last word: one for each length but the
    longest, shortest first. ``extend`` gives the states of all features that new words end."""

    def __init__(self, order: int = ORDER):
        self.states: list[int | None] = [None] * (order - 1)

    def extend(self, words: list[bytes]) -> Iterator[list[int]]:
        """States of the features of 1, 2, ... words that ``words`` end, a list a length."""
        spaced = [b" " + w for w in words]
        ended = list(map(crc32, words))
        yield ended
        for k, before in enumerate(self.states):
            # A feature grows out of the one that ended a word earlier; ``ended`` has the last words'.
            grown = list(map(crc32, spaced[len(words) - len(ended) + 1 :], ended))
            if before is not None and words:
                grown.insert(0, crc32(spaced[0], before))
            if ended:
                self.states[k] = ended[-1]
            ended = grown
            yield ended


def text_buckets(text: str | None, buckets: int = BUCKETS, order: int = ORDER):
    """(number of words, numpy array of the bucket of each feature) of a whole text."""
    import numpy as np

    words, ring, out = normalised(text).split(), Ring(order), []
    for i in range(0, len(words), CHUNK):
        for states in ring.extend(words[i : i + CHUNK]):
            out.append(np.array(states, np.int64) % buckets)
    return len(words), np.concatenate(out) if out else np.zeros(0, np.int64)


def bucket_rows(docs: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_features, codes): codes hold two bytes for each feature, least first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if buckets > 1 << 16:
        raise ValueError("a bucket takes two bytes")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts, features, codes = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = text_buckets(text, buckets, order)
                counts.append(n)
                features.append(len(found))
                codes.append(found.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(features, pa.int64()), pa.array(codes, pa.binary())], names=["doc_id", "n_words", "n_features", "codes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, codes binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS):
    """Features in each bucket over all rows (numpy): a task adds up its own, one row a task
    and bucket is shuffled and one a bucket collected."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for code in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(code, "<u2"), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bucket", "n"])

    made = np.zeros(buckets, np.int64)
    for r in rows.select("codes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        made[r.bucket] = r.n
    return made


def gains(source, target) -> list[int]:
    """Of each bucket 1000 times the log of its smoothed share in the target over that in the
    source, rounded down."""
    big_s, big_t, b = int(source.sum()), int(target.sum()), len(source)
    return [math.floor(1000 * math.log(((t + 1) * (big_s + b)) / ((s + 1) * (big_t + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def noise(seed: int, doc_id) -> int:
    """1000 times a Gumbel draw that the seed and the id fix, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of ``bucket_rows``; no shuffle."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(gain, np.int64)
        for batch in batches:
            weight = [int(table[np.frombuffer(code, "<u2")].sum()) for code in batch.column(3).to_pylist()]
            score = [w + noise(seed, d) for w, d in zip(weight, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document.

    Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn
    without replacement: those of the highest scores (weight and Gumbel noise), ranked from 1;
    ties go to the smaller id, then to the smaller weight and number of features, and rows
    alike in all of these take any order. ``rank`` is null for the rest. A null text has no
    words; a null id sorts first and takes the noise of an empty id. An empty target leaves
    weights that depend on the documents' counts alone. Other columns are ignored.

    The documents' texts are read once: what follows works on two bytes a feature, kept in
    the checkpoint folder (about one and a half times the compressed texts), then on a row of
    numbers a document. Ranks come from range partitions and their sizes.
    """
    rows = checkpointed(bucket_rows(docs))
    gain = gains(bucket_counts(rows), bucket_counts(bucket_rows(target.select(F.lit(0).alias("doc_id"), "text"))))
    scores = checkpointed(scored(rows, gain, seed))
    enough = F.col("n_words") >= least_words
    drawn = scores.where(enough).count() * percent // 100
    ready = scores.where(enough).withColumn("_tie", F.monotonically_increasing_id())
    placed = positions_by(ready, F.desc("score"), "doc_id", "weight", "n_features", "_tie", name="_seq").drop("_tie")
    rank = F.when(F.col("_seq") < drawn, F.col("_seq") + 1)
    rest = scores.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*scores.columns, rank.alias("rank")).unionByName(rest)
