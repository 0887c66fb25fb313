"""N-gram Jaccard join of documents by MinHash banding with exact verification.

Equal texts form one class. Each class's set of word n-grams is MinHashed; bands of hashes
are shuffled, and classes that share a band with others are joined to the band's least
class. That forest of candidates splits the corpus into small candidate groups, outside of
which no pair shares a band. Each text is then sent to its group once, where pairs are
verified on the full n-gram sets; large groups are cut into blocks, or into their bands.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import BY_BAND, by_size, candidate_groups, checkpointed, connected_components, least_common, pair_components, whole_groups


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5
    threshold: float = 0.8
    miss: float = 1e-6  # accepted chance to miss a pair just at the threshold
    stray: float = 0.3  # similarity at which pairs should rarely share a band
    block: int = 512  # classes of a group that one task compares with as many others
    block_chars: int = 6_000_000
    seed: int = 97

    def bands(self) -> tuple[int, int]:
        """(bands, rows): of the choices that reach the target recall at the threshold with
        at most 384 hashes, the one under which stray pairs meet least."""
        best = None
        for rows in range(1, 17):
            hit = self.threshold**rows
            bands = 1 if hit >= 1 else math.ceil(math.log(self.miss) / math.log1p(-hit))
            if bands * rows <= 384:
                meets = 1 - (1 - self.stray**rows) ** bands
                best = min(best or (2.0, 0, 0), (meets, bands, rows))
        if best is None:
            raise ValueError("no choice of bands and rows reaches the target recall with 384 hashes")
        return best[1], best[2]


GAP = 0x100000001B3
MASK = 2**64 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def ngrams(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i's n-grams are hashes[bounds[i]:bounds[i + 1]], repeats included.

    Words are what ASCII white space separates. A text of fewer than ``words`` words has one
    n-gram of all of them, a text without words has none. Hashes have 64 bits.
    """
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data]) if data else np.zeros(0, np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.r_[False, solid].astype(np.int8))
    first = np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    last = np.flatnonzero(edge == -1)
    # A word's hash: its bytes times powers of one odd number, summed and mixed.
    place = np.r_[np.zeros(first[0], np.int64), np.arange(first[0], len(raw)) - np.repeat(first, np.diff(np.r_[first, len(raw)]))]
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, GAP, np.uint64))
    terms = np.where(solid, raw.astype(np.uint64) * powers[place], np.uint64(0))
    word = _mix(np.add.reduceat(terms, first) + (last - first).astype(np.uint64))
    counts = np.diff(np.r_[0, np.searchsorted(first, ends)])
    bounds = np.r_[0, np.cumsum(counts)]
    size = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    out_bounds = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(len(texts)), size)
    start = bounds[owner] + np.arange(out_bounds[-1]) - out_bounds[owner]
    gram = np.zeros(len(start), np.uint64)
    length = np.minimum(counts, words)[owner]
    padded = np.r_[word, np.zeros(words, np.uint64)]
    for k in range(words):
        gram = np.where(k < length, _mix(gram * np.uint64(GAP) + padded[start + k] + np.uint64(k + 1)), gram)
    return gram, out_bounds


def signatures(texts: list[str], params: JaccardParams) -> np.ndarray:
    """int64 (texts, bands): hashes of each band of MinHashes; texts without words get zeros."""
    bands, rows = params.bands()
    gram, bounds = ngrams(texts, params.words)
    out = np.zeros((len(texts), bands), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out.view(np.int64)
    low, high = gram.astype(np.uint32), (gram >> np.uint64(32)).astype(np.uint32)
    odd = np.random.default_rng(params.seed).integers(0, 2**31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.full((bands * rows, len(full)), np.uint32(2**32 - 1))
    # Runs of whole texts of about 100,000 n-grams, so that the working arrays stay in cache.
    runs = np.searchsorted(bounds[full], np.arange(0, bounds[-1], 100_000))
    for i, j in zip(runs, [*runs[1:], len(full)], strict=True):
        if i == j:
            continue
        a, b = bounds[full[i]], bounds[full[j - 1] + 1]
        starts = bounds[full[i:j]] - a
        x, y, value = low[a:b], high[a:b], np.empty(b - a, np.uint32)
        for h, factor in enumerate(odd):
            np.multiply(x, factor, out=value)
            value ^= y
            value *= np.uint32(0x9E3779B1)
            least[h, i:j] = np.minimum.reduceat(value, starts)
    for band in range(bands):
        code = np.full(len(full), np.uint64((band + 1) * 0x9E3779B97F4A7C15 & MASK))
        for h in range(band * rows, (band + 1) * rows):
            code = _mix(code * np.uint64(GAP) + least[h].astype(np.uint64))
        out[full, band] = code
    return out.view(np.int64)


def similar_pairs(texts: list[str], params: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of texts whose n-gram sets have the wanted Jaccard similarity.

    Common n-grams are counted by products of incidence matrices, some thousand columns (of
    n-grams that two texts or more share) at a time; the sets are full and exact but for
    collisions of 64-bit hashes.
    """
    gram, bounds = ngrams(texts, params.words)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((owner, gram))
    gram, owner = gram[order], owner[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])] if len(gram) else np.zeros(0, bool)
    gram, owner = gram[new], owner[new]
    size = np.bincount(owner, minlength=len(texts))
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    column = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(gram)]))
    shared = np.bincount(column, minlength=len(start)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column] if len(column) else np.zeros(0, bool)
    column, owner = number[column[keep]], owner[keep]
    common = np.zeros((len(texts), len(texts)), np.float32)
    width = max(64, min(4096, 8_000_000 // max(1, len(texts))))
    for low in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [low, low + width])
        own, place = np.unique(owner[i:j], return_inverse=True)
        matrix = np.zeros((len(own), width), np.float32)
        matrix[place, column[i:j] - low] = 1
        common[np.ix_(own, own)] += matrix @ matrix.T
    both = size[:, None] + size[None, :] - common
    return np.nonzero(np.triu((common > 0) & (common >= params.threshold * both - 1e-6), 1))


def join_similar(docs: DataFrame, params: JaccardParams = JaccardParams(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, n_links), one row per row of ``docs``.

    Two documents are linked if their texts are equal or their sets of word n-grams have a
    Jaccard similarity of at least ``threshold``. n_links counts the other documents linked
    directly; class_id is the least key that links connect to the document, itself included.
    Null texts are empty; texts without words are linked to equal texts only. Rows with a null
    key get a null class and no links. Rows that share key and text are copies; rows that
    share a key but not the text are one node with the links of each text. Keys are integers.

    Shuffles: a row of band hashes per text; a row per band; the candidates' edges; the
    candidates' texts, once (of groups over ``block`` texts, once for each of its blocks or
    bands, whichever is less). A task returns counts and a spanning forest of its group, never
    the pairs. Hot texts are counted before the shuffle, hot bands give one edge a member.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = rows.select("doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(11), "text").alias("d2"), "text")
    bands, _ = params.bands()

    def sketch(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for i, j in by_size(texts, 3_000_000):
                distinct = list(dict.fromkeys(texts[i:j]))
                place = {t: n for n, t in enumerate(distinct)}
                code = signatures(distinct, params)[[place[t] for t in texts[i:j]]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, bands), pa.int32()), pa.array(code.ravel()))
                sizes = pa.array([len(t) for t in texts[i:j]], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), sizes, lists], ["doc_id", "d1", "d2", "chars", "bands"])

    sketched = marked.where("doc_id IS NOT NULL").mapInArrow(sketch, "doc_id long, d1 long, d2 long, chars long, bands array<long>")
    classes = checkpointed(
        sketched.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("chars").alias("chars"), F.first("bands").alias("bands"))
    )
    # Texts with one key are one class by its key, but each has bands and links of its own.
    numbered = classes.withColumn("own", F.xxhash64("rep", "d1", "d2"))
    groups = candidate_groups(numbered.select(F.col("own").alias("rep"), F.col("chars").alias("weight"), "bands"), params.block, params.block_chars)
    facts = numbered.select("own", "rep", "d1", "d2", "copies", "bands")
    candidates = checkpointed(
        groups.withColumnRenamed("rep", "own").join(facts, "own").withColumn("bands", F.when(F.col("pair") >= F.lit(BY_BAND), F.col("bands")))
    )
    placed = candidates.join(marked.withColumnRenamed("doc_id", "rep"), ["rep", "d1", "d2"]).select("group", "pair", "rep", "d1", "side", "copies", "alone", "text", "bands")

    def verify(batches):
        for table in whole_groups(batches, 2):
            group, pair, rep, digest = (table.column(i).to_numpy() for i in range(4))
            side, copies, alone = (table.column(i).to_numpy(zero_copy_only=False) for i in range(4, 7))
            changed = (group[1:] != group[:-1]) | (pair[1:] != pair[:-1])
            once = np.r_[True, changed | (rep[1:] != rep[:-1]) | (digest[1:] != digest[:-1])]  # repeated rows
            starts = np.flatnonzero(np.r_[True, changed])
            out = []
            for i, j in zip(starts, np.r_[starts[1:], len(group)], strict=True):
                own = i + np.flatnonzero(once[i:j])
                a, b = similar_pairs(table.column(7).take(pa.array(own)).to_pylist(), params)
                good = (side[own[a]] != side[own[b]]) | (side[own[a]] == 0)
                a, b = a[good], b[good]
                if len(a) and pair[i] >= BY_BAND:  # a pair counts in the least band that it shares
                    bands = np.array(table.column(8).take(pa.array(own)).to_pylist(), np.int64)
                    once_only = least_common(bands[a], bands[b]) == group[i]
                    a, b = a[once_only], b[once_only]
                if len(a):
                    weight = copies[own]
                    links = np.zeros(len(own), np.int64)
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    # rows come by key within a group, so the least index is the least key
                    least = pair_components(len(own), a, b)
                    hit = np.flatnonzero(links)
                    out.append((rep[own[hit]], rep[own[least[hit]]], links[hit], alone[own[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["rep", "toward", "links", "alone"])

    found = checkpointed(
        placed.repartition("group", "pair").sortWithinPartitions("group", "pair", "rep", "d1").mapInArrow(verify, "rep long, toward long, links long, alone boolean")
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min("toward").alias("toward"), F.max("toward").alias("other"))
    # A group that holds its whole component has its classes already. Only groups that do not,
    # and keys that stand in several (with different texts), must be joined up.
    several = found.join(counts.where("toward <> other").select("rep"), "rep", "left_semi").union(found.where("NOT alone"))
    spread = connected_components(several.select(F.col("rep").alias("u"), F.col("toward").alias("v")))
    named = (
        counts.join(spread.select(F.col("node").alias("rep"), F.col("component").alias("own")), "rep", "left")
        .join(spread.select(F.col("node").alias("toward"), F.col("component").alias("its")), "toward", "left")
        .select("rep", "links", F.least(F.coalesce("own", "toward"), F.coalesce("its", "toward")).alias("component"))
    )
    summary = classes.join(named, "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return marked.select("doc_id", "d1", "d2").join(summary, ["d1", "d2"], "left").select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("n_links")).otherwise(0).alias("n_links"),
    )
