"""Passages of benchmark items in documents, found by one Aho-Corasick automaton.

Texts are normalised alike on both sides: A-Z become a-z, and words are runs of digits,
letters a-z and characters beyond ASCII. Every window of ten consecutive words of an item
(the whole item, if it has fewer) is a pattern. The automaton's letters are words: each
word of the benchmark has a code point of its own, and all other words share one, so a
document is scanned once, a step a word, and matches end on word boundaries. Places of
matches are mapped back to the original text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Bytes that stand in words, lower case; all others become spaces. UTF-8 keeps ASCII bytes apart.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
OTHER, FIRST, SURROGATES = " ", 0x100, range(0xD800, 0xE000)
PIECE = 5_000  # windows of an item that stay together
AUTOMATON = 1_000_000  # normalised bytes of the benchmark that one automaton holds

HITS = "array<struct<first:long,last:long,start:long,end:long>>"
_built: dict = {}  # a Python worker's last automaton


def normalised(text: str | None) -> bytes:
    """Words keep their byte offsets in the UTF-8 of ``text``."""
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)


def patterns(pieces: list[tuple[str | None, bytes]], window: int) -> tuple[dict[bytes, str], dict[str, tuple]]:
    """(code point of each word, {coded window: (its length, ids of its items)})."""
    code: dict[bytes, str] = {}
    found: dict[str, set] = {}
    for item, data in pieces:
        words = data.split()
        for w in words:
            if w not in code:
                at = FIRST + len(code)
                code[w] = chr(at if at < SURROGATES.start else at + len(SURROGATES))
        coded = "".join([code[w] for w in words])
        for i in range(max(len(words) - window, 0) + 1):
            if coded:
                found.setdefault(coded[i : i + window], set()).update(() if item is None else (item,))
    return code, {w: (len(w), tuple(sorted(ids))) for w, ids in found.items()}


def automaton_of(windows: dict[str, tuple]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for w, value in windows.items():
        made.add_word(w, value)
    made.make_automaton()
    return made


def scan(text: str | None, code: dict[bytes, str], automaton) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, runs of words [first, last) inside matches, ids of the items)."""
    words = normalised(text).split()
    runs: list[tuple[int, int]] = []
    items: set = set()
    if not words or not len(automaton):
        return len(words), runs, items
    for end, (length, ids) in automaton.iter("".join([code.get(w, OTHER) for w in words])):
        first, last = end - length + 1, end + 1
        while runs and runs[-1][1] >= first:  # ends ascend, so runs that touch are the last ones
            first = min(first, runs.pop()[0])
        runs.append((first, last))
        items.update(ids)
    return len(words), runs, items


def originals(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """The runs with their places in ``text`` (code points, end exclusive)."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(data.translate(NORMAL))]
    out, byte, point = [], 0, 0
    for first, last in runs:
        places = []
        for to in (spans[first][0], spans[last - 1][1]):
            point += len(data[byte:to].decode("utf-8", "surrogatepass"))
            byte = to
            places.append(point)
        out.append({"first": first, "last": last, "start": places[0], "end": places[1]})
    return out


def item_pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id as string, normalised bytes): items cut into pieces of ``PIECE`` windows,
    which overlap by ``window`` - 1 words, so that no window is lost or new."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised(text).split()
                for i in range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE):
                    ids.append(item)
                    pieces.append(b" ".join(words[i : i + PIECE + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pieces, pa.binary())], names=["item_id", "words"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text")).mapInArrow(run, "item_id string, words binary")


def scanned(docs: DataFrame, pieces: list[tuple[str | None, bytes]], window: int, hits_only: bool = False) -> DataFrame:
    """One pass of ``docs`` (doc_id, text, ...) through one automaton; rows with matches alone
    if ``hits_only``. The columns after ``text`` pass through."""
    made = docs.sparkSession.sparkContext.broadcast(patterns(pieces, window))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = docs.columns[2:]

    def run(batches):
        import pyarrow as pa

        code, windows = made.value
        if made not in _built:
            _built.clear()
            _built[made] = automaton_of(windows)
        automaton = _built[made]
        for batch in batches:
            counts, hits, items = [], [], []
            for text in batch.column(1).to_pylist():
                n, runs, ids = scan(text, code, automaton)
                counts.append(n)
                hits.append(originals(text, runs) if runs else [])
                items.append(sorted(ids))
            struct = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, struct), pa.array(items, pa.list_(pa.string())), *batch.columns[2:]]
            table = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "hits", "items", *rest])
            yield table.filter(pa.array([bool(h) for h in hits])) if hits_only else table

    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, hits {HITS}, items array<string>" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in rest))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_bytes: int = AUTOMATON) -> DataFrame:
    """(doc_id, n_words, hits, items, n_hit): the words of benchmark items in every document.

    ``hits`` are runs of words inside occurrences of windows: numbers of the first word and
    past the last one, and the same in code points of the original text. ``items`` are the
    ids (as strings, sorted) of items with an occurring window.

    A null text has no words; a null item text gives no window; an item with a null id gives
    hits but no id. Repeated rows of either table count by themselves; further columns are
    ignored. Documents are read once and never shuffled while the benchmark's normalised text
    fits ``automaton_bytes``, which bounds what is broadcast. A larger benchmark is dealt to
    several automata: each scans all documents, and their hits are joined by id and text.
    """
    pieces = item_pieces(benchmark, window)
    total = pieces.agg(F.sum(F.length("words") + 1)).first()[0] or 0
    shards = -(-total // automaton_bytes)
    texts = docs.select("doc_id", "text")
    if shards <= 1:
        out = scanned(texts, [(r.item_id, bytes(r.words)) for r in pieces.distinct().collect()], window)
    else:
        # Matches of a shard are few and travel by a digest of their row; the rows stay.
        texts = texts.withColumn("row_key", F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256))
        shard = F.pmod(F.xxhash64("item_id", "words"), F.lit(shards))
        own = lambda k: [(r.item_id, bytes(r.words)) for r in pieces.where(shard == k).distinct().collect()]
        parts = scanned(texts, own(0), window, hits_only=True)
        for k in range(1, shards):
            parts = parts.unionByName(scanned(texts, own(k), window, hits_only=True))
        found = parts.groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        counts = scanned(texts, [], window).drop("hits", "items")
        empty = [F.coalesce("hits", F.array().cast(HITS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items")]
        out = counts.join(found, "row_key", "left").select("doc_id", "n_words", *empty)
        out = out.withColumn("hits", joined_runs(F.col("hits")))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])
    return out.withColumn("n_hit", n_hit)


def joined_runs(hits):
    """Runs that overlap or touch as one, in order."""

    def step(done, h):
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(last["first"].alias("first"), F.greatest(last["last"], h["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], h["end"]).alias("end"))
        touches = (F.size(done) > 0) & (last["last"] >= h["first"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(h)))

    return F.aggregate(F.array_sort(hits), F.array().cast(HITS), step)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``find_benchmark`` a document."""
    found = find_benchmark(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
