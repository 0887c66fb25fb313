"""Best-fit packing of tokenized documents into training sequences.

Every sequence is a bin with three capacities: tokens, documents and attention cost (the sum
of squared piece lengths). Pieces are placed largest first into the open bin that fits all
capacities and scores best: least weighted residual norm, or largest weighted dot product.
"""

from __future__ import annotations

import math
import os
import struct
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import by_size, checkpointed, crc32


@dataclass(frozen=True)
class PackParams:
    """Capacities of a sequence and the scoring of bins.

    None for ``documents`` or ``attention`` sets what ``tokens`` already implies, so those
    never bind. ``shard`` is the number of pieces that one task packs together: every shard
    may leave one bin half empty, so at most one sequence in ``shard`` pieces is wasted.
    """

    tokens: int = 4096
    documents: int | None = None
    attention: float | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"  # or "dot"
    shard: int = 25_000

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or float(self.tokens) ** 2], float)


class Remembered(dict):
    """Results of ``work`` by key, worked out when a key is first asked for."""

    def __init__(self, work):
        self.work = work

    def __missing__(self, key):
        value = self[key] = self.work(key)
        return value


class WordTokenizer:
    """The tokenizer of a JSON file, with a bounded cache of white-space separated words.

    The vocabulary lower-cases, drops white space and splits by letters, single digits and
    other characters, so a text's ids are those of its words, one after the other. Texts with
    characters for which that is not certain go to the library whole.
    """

    # Control characters that Python splits at and the vocabulary's pattern does not, final
    # sigma, which Python lower-cases by context, and the special tokens' marks.
    UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|startoftext|>", "<|endoftext|>")

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        # The vocabulary's own splitting pattern.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # Blocks without unassigned places: Latin, combining marks, Cyrillic, punctuation, currencies.
        self.settled = regex.compile(r"[\x00-\u036f\u0400-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
        self.cache_words, self.words, self.parts = cache_words, Remembered(self._word), Remembered(self._part)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _part(self, part: str) -> bytes:
        plain = part.isascii() and part.isalpha()  # spelled as itself
        spelled = part if plain else part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        lower = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
        if lower.isascii() or max(lower) < "\U00010000":
            if lower.isalpha():
                return self.parts[lower]
            if lower[:-1].isalpha() and lower[-1] in ".,;:!?":
                return self.parts[lower[:-1]] + self.parts[lower[-1]]
        if self.settled.fullmatch(lower):
            return b"".join(map(self.parts.__getitem__, self.pattern.findall(lower)))
        # Whether another character is a letter may depend on the version of Unicode: the library's counts.
        return np.array(self.tool.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without special tokens."""
        if len(self.words) > self.cache_words:
            self.words.clear()
        if len(self.parts) > self.cache_words:
            self.parts.clear()
        ids_of = self.words.__getitem__
        return [
            np.array(self.tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if any(x in t for x in self.UNSURE) else b"".join(map(ids_of, t.split()))
            for t in texts
        ]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize_pieces(docs: DataFrame, path: str, tokens: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut to
    ``tokens`` at most. A null text counts as empty (one id). No shuffle."""

    def run(batches):
        tool, last = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in by_size(texts, 2_000_000):
                rows = []
                for k, ids in enumerate(tool.encode(texts[i:j]), i):
                    data = ids + last
                    for start in range(0, len(data), 4 * tokens):
                        piece = data[start : start + 4 * tokens]
                        rows.append((k, start // (4 * tokens), start // 4, len(piece) // 4, crc32(piece)))
                index, number, start, length, crc = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([keys.take(index), number.cast(pa.int32()), start, length, crc], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, params: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Raises on a piece that no empty bin can hold."""
    capacity = params.capacity()
    weights = np.array(params.weights, float)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1) / capacity
    if len(demand) and (demand.max(axis=0) > 1).any():
        raise ValueError("a piece exceeds a sequence's capacities")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    least = demand.min(axis=0) if len(demand) else None
    room, name, used = np.empty((1024, 3)), np.empty(1024, np.int64), np.empty(1024, np.int64)
    count = total = 0
    tiny = 1e-12
    for n, i in enumerate(order):
        d = demand[i]
        if count:
            free = room[:count]
            fits = (free >= d - tiny).all(axis=1)
            if params.score == "dot":
                value = np.where(fits, free @ (weights * d), -np.inf)
                at = int(value.argmax())
            else:
                value = np.where(fits, ((free - d) ** 2) @ weights, np.inf)
                at = int(value.argmin())
        if not count or not fits[at]:
            if count == len(room):
                room, name, used = (np.concatenate([x, np.empty_like(x)]) for x in (room, name, used))
            at, count = count, count + 1
            room[at], name[at], used[at] = 1.0, total, 0
            total += 1
        bins[i], offsets[i] = name[at], used[at]
        used[at] += lengths[i]
        room[at] -= d
        if (room[at] < least - tiny).any():  # no piece fits any more: the last bin takes its place
            count -= 1
            room[at], name[at], used[at] = room[count], name[count], used[count]
        if n % 512 == 511 and n + 1 < len(order):  # bins that hold no piece still to come are closed
            open_ = np.flatnonzero((room[:count] >= demand[order[-1]] - tiny).all(axis=1))
            count = len(open_)
            room[:count], name[:count], used[:count] = room[open_], name[open_], used[open_]
    return bins, offsets


def pack(pieces: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``pieces`` (with a ``length`` column) plus sequence_id and offset.

    The pieces are written to the checkpoint folder once and dealt evenly, whatever their
    keys, to tasks of about ``shard`` pieces; each task packs its own. sequence_id is unique
    and otherwise arbitrary, offsets are gapless from 0. Empty input gives an empty result.
    """
    fixed = checkpointed(pieces)
    shards = max(1, math.ceil(fixed.count() / params.shard))

    def run(batches):
        from pyspark import TaskContext

        tables = list(batches)  # about ``shard`` rows of five numbers
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        bins, offsets = best_fit(table["length"].to_numpy(), params)
        first = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
        yield from table.combine_chunks().to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema if f.name not in ("sequence_id", "offset"))
    return fixed.drop("sequence_id", "offset").repartition(shards).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, params: PackParams = PackParams(), end_id: int = 1) -> DataFrame:
    """Tokenize and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(tokenize_pieces(docs, path, params.tokens, end_id), params)
