"""Document fingerprints by randomised edit embedding.

All texts are read by one shared random walk: at step j the reader notes the character under
it and moves on or stays, by a random bit that depends on j and that character only. Texts
that differ by few edits fall into step again soon after each edit, so their notes differ in
few places: edit distance becomes Hamming distance. A fingerprint samples the notes in
``slots`` places; slot s keeps the note of the last step, before the text is used up, that is
a record of a random sequence of its own. Texts of nearly equal length thus sample the same
steps, and every step is as likely as any other, whatever the length.
"""

import hashlib
import itertools
import math
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.llm.common import by_size, candidate_groups, checkpointed, connected_components, pair_components, whole_groups

PERIOD = 8192  # steps after which the walk's random bits repeat


@dataclass(frozen=True)
class WalkParams:
    slots: int = 128
    note: int = 8  # characters from the reader on that one note hashes
    seed: int = 1729


@lru_cache(maxsize=8)
def _bits(params: WalkParams) -> np.ndarray:
    """(PERIOD, 256) moves; class 0 is the end of a text, where the reader stays."""
    bits = np.random.default_rng(params.seed).integers(0, 2, (PERIOD, 256)).astype(np.int64)
    bits[:, 0] = 0
    return bits


@lru_cache(maxsize=8)
def _records(params: WalkParams) -> dict[int, np.ndarray]:
    """step -> slots whose sequence of uniform numbers has a new minimum there.

    The record after step j is past step t with chance (j + 1) / (t + 1).
    """
    rng = np.random.default_rng([params.seed, 1])
    out: dict[int, list[int]] = {}
    for s in range(params.slots):
        j = 0
        while j < 2**33:
            out.setdefault(j, []).append(s)
            j = math.floor((j + 1) / rng.random())
    return {j: np.array(s) for j, s in out.items()}


def _classes(points: np.ndarray) -> np.ndarray:
    """Classes 1..255 of code points: Latin text keeps its own, others share them by a hash."""
    spread = (points * np.uint32(2654435761)) >> np.uint32(24)
    return np.maximum(np.where(points < 256, points, spread), 1).astype(np.uint8)


def fingerprints(texts: list[str], params: WalkParams = WalkParams()) -> list[bytes]:
    """One byte a slot. All texts walk in step, each until it is used up, so a fingerprint does
    not depend on the others; equal texts have equal fingerprints, empty ones zeros.

    A walk ends: every class of characters has moves among the period's random bits, and no
    text, however chosen, makes the reader stay more than some ten steps a character.
    """
    distinct = sorted(set(texts), key=lambda t: (-len(t), t))
    out = np.zeros((len(distinct), params.slots), np.uint8)
    lengths = np.array([len(t) for t in distinct], np.int64)
    gap = params.note
    starts = np.r_[0, np.cumsum(lengths + gap)][:-1].astype(np.int64)
    flat = np.zeros(int(lengths.sum()) + gap * len(distinct) + gap, np.uint8)
    for t, at in zip(distinct, starts, strict=True):
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        # Latin text keeps its code points; others share classes 1..255 by a hash.
        flat[at : at + len(points)] = _classes(points)
    bits, records = _bits(params), _records(params)
    powers = np.uint64(0x9E3779B97F4A7C15) * np.cumprod(np.full(params.note, 0x100000001B3, np.uint64))
    alive, at = np.arange(len(distinct)), starts.copy()
    for j in itertools.count():
        if j % 64 == 0:
            going = flat[at] != 0
            if not going.all():
                alive, at = alive[going], at[going]
            if not len(alive):
                break
        under = flat[at]
        slots = records.get(j)
        if slots is not None:
            here = np.flatnonzero(under)
            gram = flat[at[here][:, None] + np.arange(params.note)].astype(np.uint64) @ powers + np.uint64((j + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
            note = ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.uint8)
            out[alive[here][:, None], slots[None, :]] = note[:, None]
        at += bits[j % PERIOD].take(under)
    found = {t: out[i].tobytes() for i, t in enumerate(distinct)}
    return [found[t] for t in texts]


def likeness(a: bytes, b: bytes) -> float:
    """Share of slots that agree."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    return float((x == y).mean()) if len(x) else 1.0


def independent(params: WalkParams, walks: int) -> list[WalkParams]:
    """Parameters of walks that share nothing; the first are the given ones."""
    return [replace(params, seed=params.seed + 7919 * w) for w in range(walks)]


def fingerprint_documents(docs: DataFrame, params: WalkParams = WalkParams(), text: str = "text", key: str = "doc_id", walks: int = 1) -> DataFrame:
    """(doc_id, n_chars, fingerprint hex) of every row; null texts are empty. No shuffle. Of
    several independent walks the fingerprints follow each other in one string."""
    every = independent(params, walks)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in by_size(texts, 24_000_000):
                codes = [b"".join(x).hex() for x in zip(*(fingerprints(texts[i:j], p) for p in every), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(codes, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")


def compare_with_next(docs: DataFrame, params: WalkParams = WalkParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is that of the next key in ascending order (null keys first, equal keys
    by text; after the last: the first; a lone document is its own next one). The edited text
    is the document with its last floor(n/2) code points replaced by the next one's first as
    many, or all. Null texts are empty.

    One shuffle of the texts: keys are cut into ranges at their quantiles, every range gets
    the first document of the next range as a guest, and a task reads its ranges in order, so
    no global sort and no single task is needed.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    spark = docs.sparkSession
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / count for i in range(1, count)]
    cuts = rows.agg(F.percentile_approx("k", shares, max(10_000, 4 * count)).alias("q"), F.max("k").alias("top")).first()
    if cuts.top is None:
        bounds = [0]
    else:
        bounds = sorted({*cuts.q, cuts.top})
    ranges = len(bounds)
    rows = rows.withColumn("range", _range_of(F.col("k"), bounds))
    least = rows.groupBy("range").agg(F.min("k").alias("k"))  # a row a range, of which the number is bounded
    heads = rows.join(F.broadcast(least), ["range", "k"]).groupBy("range", "k").agg(F.min("text").alias("text"))
    guests = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", "k", F.pmod(F.col("range") - 1, F.lit(ranges)).cast("int").alias("range"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).select("doc_id", "text", "k", "range", "guest").union(guests)

    def run(batches):
        held = None  # the last row, whose next one is still to come

        def record(own, texts):
            edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
            codes = fingerprints([*texts, *edited], params)
            plain, changed = codes[: len(texts)], codes[len(texts) :]
            keep = [i for i, (_, guest, _) in enumerate(own[:-1]) if not guest]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([own[i][0] for i in keep], pa.int64()),
                    pa.array([len(texts[i]) for i in keep], pa.int64()),
                    pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
                    pa.array([plain[i].hex() for i in keep], pa.string()),
                    pa.array([changed[i].hex() for i in keep], pa.string()),
                    pa.array([likeness(plain[i], changed[i]) for i in keep], pa.float64()),
                    pa.array([likeness(plain[i], plain[i + 1]) for i in keep], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            own = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if held is not None:
                own.insert(0, held)
            start = 0
            for _, j in by_size([t for *_, t in own[:-1]], 12_000_000):
                part = own[start : j + 1]
                yield record(part, [t for *_, t in part])
                start = j
            held = own[-1]

    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", "k", "text").select("doc_id", "text", "guest")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _range_of(k, bounds: list[int]):
    """Column: number of bounds below ``k``, by binary search in Arrow batches of ``k`` alone
    (a search tree of expressions would grow with the number of ranges)."""
    sorted_bounds = np.array(bounds, np.int64)

    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sorted_bounds, keys.to_numpy(), side="left").astype(np.int32))

    return F.pandas_udf(place, T.IntegerType())(k)


def near_texts(docs: DataFrame, least: float = 0.7, bands: int = 24, width: int = 3, block: int = 1000, params: WalkParams = WalkParams(), text: str = "text", key: str = "doc_id", walks: int = 2) -> DataFrame:
    """(doc_id, class_id): texts in few edits of each other get one class, the least key.

    Equal texts form one group first. One walk may lose its step behind an edit for long, so
    each text takes ``walks`` independent ones, and two texts are near if one of them says so.
    Every band samples ``width`` slots of one walk's fingerprint at random; texts that meet in
    a bucket are verified by the share of slots that agree, in the groups of ``candidate_groups``, so no task gathers a hot bucket; a task returns a
    spanning forest. Rows with null keys get a null class. Keys are integers. A pair that
    agrees in a share s of the slots meets with chance 1 - (1 - s ** width) ** bands: 0.99995
    at the least share 0.7, surely above.
    """
    walked = fingerprint_documents(docs, params, text, key, walks).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Texts walk once. Of bytes a place is read at once, of a string by counting up to it.
    marked = checkpointed(walked.select("doc_id", F.xxhash64("fingerprint", "n_chars").alias("own"), F.unhex("fingerprint").alias("code")))
    prints = checkpointed(marked.groupBy("own", "code").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"))
    rng = np.random.default_rng([params.seed, 2])
    samples = [w * params.slots + rng.choice(params.slots, width, replace=False) for w in range(walks) for _ in range(bands)]
    keys = [F.xxhash64(F.lit(b), *[F.substring("code", int(s) + 1, 1) for s in own]) for b, own in enumerate(samples)]
    # Texts of one key are several: each is a node of its own until the classes are named.
    groups = candidate_groups(prints.select(F.col("own").alias("rep"), F.lit(1).cast("long").alias("weight"), F.array(*keys).alias("bands")), block, block)
    facts = prints.select("own", F.col("rep").alias("key"), "code")
    placed = groups.join(facts, groups["rep"] == facts["own"]).select("group", "pair", F.col("key").alias("rep"), "side", "code")
    need = math.ceil(least * params.slots)

    def verify(batches):
        for table in whole_groups(batches, 2):
            group, pair, rep = (table.column(i).to_numpy() for i in range(3))
            side = table.column(3).to_numpy()
            codes = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8).reshape(-1, walks, params.slots)
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (pair[1:] != pair[:-1])])
            for i, j in zip(starts, np.r_[starts[1:], len(group)], strict=True):
                a, b = alike(codes[i:j], side[i:j], need)
                low = pair_components(j - i, a, b)
                hit = np.flatnonzero(low != np.arange(j - i))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[i:j][hit]), pa.array(rep[i:j][low[hit]])], ["u", "v"])

    links = placed.repartition("group", "pair").sortWithinPartitions("group", "pair", "rep").mapInArrow(verify, "u long, v long")
    classes = connected_components(links)
    named = prints.join(classes, F.col("rep") == F.col("node"), "left").select("own", F.coalesce("component", "rep").alias("class_id"))
    return marked.select("doc_id", "own").join(named, "own", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def alike(codes: np.ndarray, side: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of rows (of one or several codes each) of which one code agrees in
    ``need`` places or more; rows of sides 1 and 2 are paired with the other side only."""
    codes = codes.reshape(len(codes), -1, codes.shape[-1])
    count = np.uint8 if codes.shape[-1] < 256 else np.int64  # adding bytes up takes half the time
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(codes), 16):
        equal = (codes[i : i + 16, None] == codes[None, i:]).view(np.uint8)
        agree = (np.add.reduce(equal, axis=3, dtype=count) >= need).any(axis=2)
        agree &= (side[i : i + 16, None] != side[None, i:]) | (side[None, i:] == 0)
        a, b = np.nonzero(np.triu(agree, 1))
        left.append(a + i)
        right.append(b + i)
    return np.concatenate(left), np.concatenate(right)
