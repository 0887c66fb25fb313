"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Spark deals the documents out; each task splits its texts, and one recursive query per
batch encodes the words that its cache lacks: token-position rows join the merge table, the
leftmost pair of least rank of every word is contracted, and words without a pair leave the
recursion. In a long word every pair is contracted that is such a one for as many tokens
around it as a token can have bytes: no merge from further away can reach it before its turn.
A very long word is encoded by overlapping parts, each different part once, and the parts'
tokens are put together where neighbours agree on a token. That is exact: a sequence of tokens
is a word's encoding if every two neighbours are the encoding of their joint bytes, since the
first contraction across a boundary would happen in these two alone as well; and neighbours
inside a part's encoding are such.
Decoding is one ordered aggregation of the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import by_size

# Unicode White_Space, which the rank files' pattern means by \s.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNUSUAL = re.compile("[\\t\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
INNER = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")

ENCODE = """
WITH RECURSIVE state(w, t, done) AS (
  SELECT w, t, false FROM words
  UNION ALL
  (WITH live AS MATERIALIZED (SELECT w, t FROM state WHERE NOT done),
        pairs AS (SELECT w, unnest(t[:-2]) AS a, unnest(t[2:]) AS b, unnest(range(1, len(t))) AS i FROM live),
        best AS (SELECT w, min(r::BIGINT * 4294967296 + i) AS k FROM pairs JOIN merges USING (a, b) GROUP BY w)
   SELECT live.w,
          CASE WHEN k IS NULL THEN t
               ELSE t[:(k % 4294967296) - 1] || [(k // 4294967296)::INTEGER] || t[(k % 4294967296) + 2:] END,
          k IS NULL
   FROM live LEFT JOIN best USING (w))
)
SELECT w, t FROM state WHERE done ORDER BY w
"""

# ``shaken``: where some token of lower rank holds the pair's bytes, by blocks of 256 bytes.
# Elsewhere contracting one occurrence cannot start merges that reach another first, and all of
# a window may go at once: of a run of pairs that overlap, every other one, if nothing can
# change where the run begins. Where it may, and near the word's start, where a space may
# stand, only the leftmost of a window goes.
ENCODE_LONG = """
WITH RECURSIVE state(w, p, t, done) AS (
  SELECT w, p, t, false FROM long_words
  UNION ALL
  (WITH paired AS (SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS b, row_number() OVER (PARTITION BY w ORDER BY p) AS i
                   FROM state WHERE NOT done),
        ranked AS (SELECT w, p, i, paired.t, r, i = 1 OR r IS DISTINCT FROM lag(r) OVER (PARTITION BY w ORDER BY p) AS fresh
                   FROM paired LEFT JOIN merges ON merges.a = paired.t AND merges.b = paired.b),
        placed AS (SELECT w, p, i, t, r, max(CASE WHEN fresh THEN i END) OVER (PARTITION BY w ORDER BY p) AS run,
                          min(r::BIGINT * 4294967296 + p) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS k
                   FROM ranked),
        settled AS (SELECT w, p, i, t, r, k, run, first_value(r = k // 4294967296) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN i - run PRECEDING AND CURRENT ROW) AS ready
                    FROM placed),
        chosen AS (SELECT w, p, t, r, coalesce(r = k // 4294967296 AND (p = k % 4294967296 OR (block IS NULL AND ready AND i > {reach} AND (i - run) % 2 = 0)), false) AS hit
                   FROM settled LEFT JOIN shaken ON id = r AND block = p // 256),
        stepped AS (SELECT w, p, CASE WHEN hit THEN r ELSE t END AS t, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone,
                           NOT bool_or(hit) OVER (PARTITION BY w) AS done FROM chosen)
   SELECT w, p, t, done FROM stepped WHERE NOT gone)
)
SELECT w, list(t ORDER BY p) AS t FROM state WHERE done GROUP BY w ORDER BY w
"""
LONG = 96  # bytes of a word from which on it is a long one
HUGE = 1024  # bytes from which on it is encoded by overlapping parts
PART, OVERLAP = 512, 128

DECODE = """
SELECT d, string_agg(s, '' ORDER BY p) AS t FROM tokens JOIN vocabulary USING (id) GROUP BY d ORDER BY d
"""


class Cache:
    """Bytes by string, in two generations: what is asked for moves to the young one, and when
    that holds half of ``most`` bytes the old one is dropped. An entry counts 200 bytes and its
    contents."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.held = most, {}, {}, 0

    def unknown(self, wanted: set[str]) -> set[str]:
        """Those of ``wanted`` that are not held; the others are young now."""
        missed = wanted - self.young.keys()
        if self.old:
            self.add({x: self.old[x] for x in missed & self.old.keys()})
            missed -= self.young.keys()
        return missed

    def add(self, new: dict[str, bytes]) -> None:
        self.young.update(new)
        self.held += sum(map(len, new)) + sum(map(len, new.values())) + 200 * len(new)

    def trim(self) -> None:
        if self.held > self.most // 2:
            self.old, self.young, self.held = self.young if self.held <= self.most else {}, {}, 0


class Codec:
    """Ranks, merge table and caches of one Python worker.

    The caches of words and of chunks hold at most ``cache_bytes`` each between batches, so a
    task's memory does not grow with its input.
    """

    def __init__(self, ranks_path: str, pattern: str, cache_bytes: int = 160_000_000, memory: str = "256MB"):
        import duckdb
        import regex

        with open(ranks_path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        spelled = pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")
        self.pattern = regex.compile(spelled)
        self.cache, self.words = Cache(cache_bytes), Cache(cache_bytes)
        self.beginnings: set[bytes] = set()  # of tokens; made when a long word is met
        self.windows: dict[bytes, tuple[int, tuple[int, ...]]] = {}  # what _shaken found in them
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": tempfile.gettempdir()})
        get = self.ranks.get
        merges = [(get(k[:i]), get(k[i:]), r) for k, r in self.ranks.items() for i in range(1, len(k)) if k[:i] in self.ranks and k[i:] in self.ranks]
        a, b, r = np.array(merges, np.int32).reshape(-1, 3).T
        self._table("merges", a=a, b=b, r=r)
        self._table("vocabulary", id=np.array(list(self.ranks.values()), np.int32), s=pa.array([k.decode("latin-1") for k in self.ranks], pa.string()))
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for k, r in self.ranks.items():
            self.sizes[r] = len(k)
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        # Two bytes that no token holds side by side never merge: words are cut there.
        self.joined = np.zeros((256, 256), bool)
        for k in self.ranks:
            for x, y in zip(k, k[1:], strict=False):
                self.joined[x, y] = True

    def _table(self, name: str, **columns) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _merge(self, parts: list[bytes], whole: bool = True) -> list[bytes]:
        """Token ids (as little-endian bytes) that contraction gives for byte strings."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.flatnonzero(~self.joined[raw[:-1], raw[1:]]) + 1 if len(raw) > 1 else np.array([], np.int64)
        bounds = np.union1d(offsets, cuts)
        ids, size = self.byte_id[raw], np.diff(bounds)
        huge = np.flatnonzero(size >= HUGE)
        if len(huge) and whole:
            pieces = [raw[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
            rest = [x for x in pieces if len(x) < HUGE]
            small = iter(self._merge(rest) if rest else [])
            coded = [self._by_parts(x).tobytes() if len(x) >= HUGE else next(small) for x in pieces]
            owner = np.searchsorted(offsets, bounds[:-1], side="right") - 1
            out: list[list[bytes]] = [[] for _ in parts]
            for i, x in zip(owner, coded, strict=True):
                out[i].append(x)
            return [b"".join(x) for x in out]
        far = size >= LONG
        if not far.any():
            flat, counts = self._short(bounds, ids)
        else:
            counts, tokens = np.empty(len(size), np.int64), np.empty(len(size), object)
            near = np.flatnonzero(~far)
            of_byte = np.repeat(far, size)
            short, number = self._short(np.r_[0, np.cumsum(size[near])], ids[~of_byte])
            for i, found in zip(near, np.split(short, np.cumsum(number)[:-1]) if len(near) else [], strict=True):
                tokens[i] = found
            for i, found in zip(np.flatnonzero(far), self._long(np.flatnonzero(far), bounds, raw, ids), strict=True):
                tokens[i] = found
            counts[:] = [len(t) for t in tokens]
            flat = np.concatenate(list(tokens))
        ends = np.r_[0, np.cumsum(counts)][np.searchsorted(bounds, offsets)] * 4
        data = flat.astype("<u4").tobytes()
        return [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def _by_parts(self, data: bytes) -> np.ndarray:
        """Tokens of a very long word (see above), in time linear in its length where parts
        come to agree. Where two parts share no token, the next part begins at a token of the
        last one and must begin with it, which repeated text gives at once: its parts repeat,
        too. If nothing agrees, the whole word is contracted."""
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def tokens(contents: list[bytes]) -> None:
            fresh = list(dict.fromkeys(c for c in contents if c not in known))
            if fresh:
                for c, x in zip(fresh, self._merge(fresh, whole=False), strict=True):
                    ids = np.frombuffer(x, "<u4")
                    known[c] = ids, np.r_[0, np.cumsum(self.sizes[ids])]

        starts = list(range(0, max(len(data) - OVERLAP, 1), PART - OVERLAP))
        tokens([data[i : i + PART] for i in starts])
        out: list[np.ndarray] = []
        at, first = 0, 0  # the part in hand and the first of its tokens that is not given yet
        content = data[:PART]
        while True:
            ids, places = known[content]
            end = at + len(content)
            if end >= len(data):
                return np.concatenate([*out, ids[first:]]).astype("<u4")
            step = self._agreed(data, known, starts, at, content, first) or self._restarted(data, known, tokens, at, content, first)
            if step is None:
                return np.frombuffer(self._merge([data], whole=False)[0], "<u4")
            last, at, content, begin = step
            out.append(ids[first:last])
            first = begin

    @staticmethod
    def _agreed(data, known, starts, at, content, first):
        """(tokens to take, the next part's start, its content, its first token) where a part
        that goes further has a token of this one at the same place."""
        ids, places = known[content]
        end = at + len(content)
        i = min((end - 1) // (PART - OVERLAP), len(starts) - 1)
        while i >= 0 and starts[i] > at:
            other = data[starts[i] : starts[i] + PART]
            if starts[i] + len(other) > end:
                theirs = known[other][1] + starts[i]
                mine = places + at
                key = lambda x: x[:-1] * (1 << 32) + x[1:]
                _, a, b = np.intersect1d(key(mine), key(theirs), assume_unique=True, return_indices=True)
                good = np.flatnonzero(a >= first)
                if len(good):
                    k = good[len(good) // 2]
                    return int(a[k]), starts[i], other, int(b[k])
            i -= 1
        return None

    @staticmethod
    def _restarted(data, known, tokens, at, content, first):
        """The same with a part that begins at a token of this one, known parts before others."""
        ids, places = known[content]
        trial = [k for k in range(len(ids) - 1, first, -1) if places[k] <= len(content) - min(OVERLAP, len(content) // 4)]
        ready = [k for k in trial if data[at + places[k] : at + places[k] + PART] in known]
        for k in [*ready, *trial[:16]]:
            start = at + int(places[k])
            other = data[start : start + PART]
            tokens([other])
            if start + len(other) > at + len(content) and known[other][0][0] == ids[k]:
                return k, start, other, 0
        return None

    def _short(self, bounds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, their number in each word) of the words between ``bounds``."""
        segments = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        self.con.register("words", pa.table({"w": pa.array(np.arange(len(segments)), pa.int64()), "t": segments}))
        tokens = self.con.sql(ENCODE).to_arrow_table()["t"].combine_chunks()
        self.con.unregister("words")
        return tokens.flatten().to_numpy(), np.diff(tokens.offsets.to_numpy())

    def _long(self, which: np.ndarray, bounds: np.ndarray, raw: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Tokens of the long words ``which``, some 200,000 bytes or one word at a time."""
        out: list[np.ndarray] = []
        for first, last in by_size([range(bounds[i], bounds[i + 1]) for i in which], 200_000):
            own = which[first:last]
            base = bounds[own[0]]
            reach, shaken = 3, set()
            for i in own:
                longest, found = self._shaken(raw[bounds[i] : bounds[i + 1]].tobytes(), int(bounds[i] - base))
                reach = max(reach, longest + 2)
                shaken |= found
            self._table("shaken", id=np.array([r for r, _ in shaken], np.int32), block=np.array([b for _, b in shaken], np.int64))
            places = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in own])
            words = np.repeat(np.arange(len(own)), bounds[own + 1] - bounds[own])
            self.con.register("long_words", pa.table({"w": words, "p": places - places[0], "t": ids[places]}))
            found = self.con.sql(ENCODE_LONG.format(reach=reach)).to_arrow_table()["t"].combine_chunks()
            self.con.unregister("long_words")
            out += [x.values.to_numpy() for x in found]
        return out

    def _shaken(self, data: bytes, base: int) -> tuple[int, set[tuple[int, int]]]:
        """Length of the longest token that stands in ``data``, and (token, block of 256 bytes)
        where a token of lower rank stands that holds it, a block more on either side. Places
        count from ``base``. A space stands at a word's start only or all through it."""
        if not self.beginnings:
            self.beginnings = {k[:j] for k in self.ranks for j in range(2, len(k) + 1)}
            self.longest = max(map(len, self.ranks))
        rank, shaken, most = self.ranks, set(), 1
        known = self.windows
        for at in range(len(data)):
            window = data[at : at + self.longest]
            if window not in known:
                if len(known) > 50_000:
                    known.clear()
                size, parts = 1, set()
                for n in range(2, len(window) + 1):
                    holder = window[:n]
                    if holder not in self.beginnings:
                        break
                    if holder in rank:
                        size = n
                        inner = (holder[i:j] for i in range(n) for j in range(i + 2, n + 1))
                        parts.update(rank[x] for x in inner if rank.get(x, -1) > rank[holder] and (b" " in x or b" " not in holder))
                known[window] = size, tuple(parts)
            size, parts = known[window]
            most = max(most, size)
            block = (base + at) // 256
            for r in parts:
                shaken |= {(r, block - 1), (r, block), (r, block + 1)}
        return most, shaken

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks, of which none splits a match of the pattern.

        Chunks that begin with a space and end with none may be read in one go: the places
        between them are such as texts are cut at.
        """
        plain = [c for c in chunks if c[0] == " " and not c[-1].isspace()]
        words = self.pattern.findall("".join(plain))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        if sizes.sum() != (ends[-1] if len(ends) else 0):
            raise ValueError("the pattern leaves characters out")
        rest = {c: self.pattern.findall(c) for c in chunks.difference(plain)}
        wanted = set(words).union(*rest.values())
        fresh, open_words = {}, []
        for word in self.words.unknown(wanted):
            data = word.encode()
            if (r := self.ranks.get(data)) is not None:
                fresh[word] = r.to_bytes(4, "little")
            else:
                open_words.append((word, data))
        if open_words:
            fresh.update(zip([w for w, _ in open_words], self._merge([d for _, d in open_words]), strict=True))
        self.words.add(fresh)
        known = self.words.young
        parts = [known[w] for w in words]
        flat = b"".join(parts)
        after = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        stops = after[np.searchsorted(np.cumsum(sizes), ends)].tolist() if plain else []
        out = {c: flat[i:j] for c, i, j in zip(plain, [0, *stops], stops, strict=False)}
        out.update((c, b"".join([known[w] for w in own])) for c, own in rest.items())
        self.words.trim()
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Cut before every single space that stands between two other characters.

        The pattern has an optional leading space, so no match crosses such a place.
        """
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or UNUSUAL.search(text):
            first, *rest = INNER.split(text)
        else:
            first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.chunks(t) if t else [] for t in texts]
        fresh = self.cache.unknown(set().union(*split))
        if fresh:
            self.cache.add(self._learn(fresh))
        get = self.cache.young.__getitem__
        out = [b"".join(map(get, parts)) for parts in split]
        self.cache.trim()
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that little-endian unsigned 32-bit ids stand for; raises on an unknown id."""
        arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        sizes = [len(a) for a in arrays]
        flat = np.concatenate([*arrays, np.array([], np.int32)])
        tokens = {"d": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "p": np.arange(len(flat), dtype=np.int64), "id": flat}
        self.con.register("tokens", pa.table(tokens))
        found = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("tokens")
        out = [b""] * len(ids)
        for d, t in zip(found["d"].to_pylist(), found["t"].to_pylist(), strict=True):
            out[d] = t.encode("latin-1")
        if any(n and not o for n, o in zip(sizes, out, strict=True)):
            raise ValueError("ids outside the vocabulary")
        return out


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``.

    The whole text is encoded without special tokens, as the tiktoken library would; null
    and empty texts have no ids (hashes of no bytes). Repeated rows stay repeated, the key
    may be null, other columns are ignored. decoded_sha256 is made from the ids alone.
    With ``ids=False`` the array is left out. There is no shuffle; a task keeps a batch of
    about four million characters, one text at least. Time is linear in the text, and in the
    length of a single match of the pattern (a run of letters, say) where parts of it come to
    agree, as they do in prose, random letters and repeated strings.
    """

    def run(batches):
        tool = codec(ranks_path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in by_size(texts, 4_000_000):
                coded = tool.encode(texts[i:j])
                plain = tool.decode(coded)
                columns = [
                    keys.slice(i, j - i),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in plain]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(doc_id, text): the text of every id array; null arrays give empty texts.

    Bytes that are no UTF-8 (ids cut inside a character) become replacement characters.
    """

    def run(batches):
        tool = codec(ranks_path, pattern)
        for batch in batches:
            arrays = [np.asarray(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "replace") for x in tool.decode(arrays)], pa.string())], ["doc_id", "text"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
