"""Personal data: exact patterns, widened by a skip-chain conditional random field.

The patterns' spans always stay. A field over a document's suspicious words (those with a
digit or @, and those that repeat a part of one) labels each as one of the kinds or none.
Neighbours share chain potentials; distant words with the same or a similar spelling share
skip potentials through a hub, and loopy message passing makes their labels agree. Words in
pattern spans are observed; other words that the field is sure of become further spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import by_size

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits matches from its first one or not at all, so no other start need be tried.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
MARK = re.compile("[0-9@]")
SPACE = re.compile(r"\s")
WORD = re.compile(r"\S+")
EDGE = ".,;:!?\"'()[]{}<>"  # what may stand around a word
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind, then start; leftmost and non-overlapping in a kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:  # an address's local part is all that may stand before its @
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


@dataclass(frozen=True)
class CrfParams:
    documents: int = 4000  # sampled documents with a digit or @ that weights are fitted on
    sweeps: int = 6  # rounds of message passing
    sure: float = 0.95  # least posterior of a further span
    core: int = 6  # letters and digits of a part by which words are similar; shorter parts must be whole words
    longest: int = 100_000  # characters of a sampled text; longer texts teach nothing, but are searched
    ridge: float = 1.0
    mentions: int = 4  # masked further mentions that each sampled word gets to learn skip potentials from
    steps: int = 300


@dataclass
class Word:
    start: int
    end: int
    label: int  # kind of the pattern span over it, or NONE


def lowered(text: str) -> str:
    """Lower case character by character, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def words_of(text: str, spans: list[Span], core: int) -> tuple[list[Word], list[str]]:
    """Suspicious words in order, with the spelling by which each is tied to others. One pass
    over the text for the words, one for all the parts together."""
    found: dict[int, int] = {}

    def word_at(place: int, least: int) -> tuple[int, int]:
        start = place
        while start > least and not text[start - 1].isspace():
            start -= 1
        space = SPACE.search(text, place)
        return start, space.start() if space else len(text)

    end = 0
    for m in MARK.finditer(text):
        if m.start() >= end:
            start, end = word_at(m.start(), end)
            found[start] = end
    parts, short = set(), {}  # short: start of an address -> its local part
    for kind, a, b in spans:
        if kind == 0:
            local = text[a:b].split("@")[0].lower()
            if len(local) >= core:
                parts.add(local)
            elif local.strip(EDGE):
                short[a] = local.strip(EDGE)
    low = lowered(text) if parts or short else ""
    tied: dict[int, str] = {}  # start of a word -> the least part in it
    if parts:
        search = ahocorasick.Automaton()
        for part in parts:
            search.add_word(part, part)
        search.make_automaton()
        start = end = 0
        for last, part in search.iter(low):
            if last >= end:
                start, end = word_at(last, end)
            found.setdefault(start, end)
            tied[start] = min(part, tied.get(start, part))
    whole, starts = set(short.values()), sorted(short)
    if whole:
        for m in WORD.finditer(low):
            if m[0].strip(EDGE) in whole:
                found.setdefault(*m.span())
    out, ties = [], []
    coming, over = deque(sorted(spans, key=lambda s: s[1])), []  # over: spans that may reach the word
    for a, b in sorted(found.items()):
        while coming and coming[0][1] < b:
            over.append(coming.popleft())
        over = [s for s in over if s[2] > a]
        label = over[0][0] if over else NONE
        tie = tied.get(a)
        if tie is None and starts:
            i = bisect_left(starts, a)
            tie = short[starts[i]] if i < len(starts) and starts[i] < b else None
        out.append(Word(a, b, label))
        ties.append(tie or re.sub(r"[^0-9a-z]", "", lowered(text[a:b])))
    return out, ties


FEATURES = 22


def features(text: str, word: Word) -> np.ndarray:
    """Shape of a word and of what stands by it; none tells whether a pattern matched."""
    w = text[word.start : word.end].strip(".,;:!?\"'()[]{}<>")
    digits = sum(c.isdigit() for c in w)
    letters = sum(c.isalpha() for c in w)
    before = text[max(0, word.start - 2) : word.start].strip()
    after = text[word.end : word.end + 2].strip()
    at, dots = w.count("@"), w.count(".")
    values = [
        1, at == 1, at > 1, dots == 0, dots == 1, dots == 2, dots == 3, dots > 3, w[:1] == "+", "-" in w, letters == 0, 0 < letters <= 4, letters > 4,
        digits == 0, 1 <= digits <= 3, 4 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19, "=" in w or "/" in w or "_" in w,
        before[-1:].isdigit() or before[-1:] in ("+", ")"), after[:1].isdigit() or after[:1] == "(",
    ]
    return np.array(values, float)


@dataclass
class Field:
    """Weights: unary (features, labels), chain (labels, labels), skip (labels; one value, as a
    label of a larger one would win in every large group)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, x: np.ndarray, near: np.ndarray, tie: np.ndarray, known: np.ndarray, sweeps: int) -> np.ndarray:
        """Posteriors by loopy sum-product messages. ``near[i]``: word i follows word i-1 at
        once; ``tie``: group of like spellings; ``known``: observed label or -1.

        A group's words meet in a hub variable, so the messages of a group are as many as its
        words. All messages of a sweep are passed at once.
        """
        n, k = len(x), self.unary.shape[1]
        local = x @ self.unary
        observed = known >= 0
        local[observed] = -30
        local[observed, known[observed]] = 0
        chain = np.exp(np.clip(self.chain, -20, 20))
        # With these between word and hub, two words affect each other through the hub as by
        # the skip potential between them.
        direct = np.exp(np.clip(self.skip, 0, 20))
        agree = np.ones((k, k))
        np.fill_diagonal(agree, direct + np.sqrt(np.maximum(direct**2 + (k - 2) * direct - (k - 1), 0)))
        groups = int(tie.max()) + 1 if n else 0
        size = np.bincount(tie, minlength=groups)
        left = right = np.zeros((n, k))  # logs of messages from the word before, after
        from_hub = np.zeros((n, k))
        for _ in range(sweeps):
            total = local + left + right + from_hub
            out_right = np.log(_normal(total - right) @ chain + 1e-300)  # to the next word
            out_left = np.log(_normal(total - left) @ chain.T + 1e-300)
            new_left, new_right = np.zeros((n, k)), np.zeros((n, k))
            new_left[1:][near[1:]] = out_right[:-1][near[1:]]
            new_right[:-1][near[1:]] = out_left[1:][near[1:]]
            to_hub = np.log(_normal(total - from_hub) @ agree + 1e-300)
            hub = np.zeros((groups, k))
            np.add.at(hub, tie, to_hub)
            back = np.log(_normal(hub[tie] - to_hub) @ agree + 1e-300)
            from_hub = np.where((size[tie] > 1)[:, None], back, 0.0)
            left, right = new_left, new_right
        return _normal(local + left + right + from_hub)


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _graph(text: str, words: list[Word], ties: list[str]):
    x = np.array([features(text, w) for w in words])
    near = np.array([False, *(b.start - a.end <= 1 for a, b in zip(words, words[1:], strict=False))])
    names = {t: i for i, t in enumerate(dict.fromkeys(ties))}
    return x, near, np.array([names[t] for t in ties]), np.array([w.label for w in words])


def fit_field(texts: list[str], params: CrfParams = CrfParams()) -> Field:
    """Maximum pseudo-likelihood with the patterns' labels, by gradient ascent with momentum.

    Every word's label is predicted from its shape, its neighbours' labels and the labels of
    its like-spelled words; no word sees its own. What a pattern does not match but repeats a
    matched word is left out: whether that is personal data is what the field is asked. Skip
    potentials are learned from masked mentions: each word counts ``mentions`` times more with
    its shape and neighbours hidden, so that only its like-spelled words, among them the word
    itself, tell its label. Where like spellings disagree, these examples pull them down.
    """
    k = NONE + 1
    rows, prev, nxt, same, y, weight = [], [], [], [], [], []
    for text in texts:
        words, ties = words_of(text, base_spans(text), params.core)
        if not words:
            continue
        x, near, tie, label = _graph(text, words, ties)
        hot = np.eye(k)[label]
        count = np.zeros((tie.max() + 1, k))
        np.add.at(count, tie, hot)
        others = count[tie] - hot
        told = (label != NONE) | (others[:, :NONE].sum(axis=1) == 0)
        before = np.where(near[:, None], np.r_[np.zeros((1, k)), hot[:-1]], 0)
        after = np.where(np.r_[near[1:], False][:, None], np.r_[hot[1:], np.zeros((1, k))], 0)
        share = others / np.maximum(others.sum(axis=1, keepdims=True), 1)
        masked = np.zeros_like(x)
        masked[:, 0] = 1
        all_ = count[tie] / count[tie].sum(axis=1, keepdims=True)
        nothing = np.zeros_like(before)
        for own, b, a, s, w in ((x, before, after, share, 1), (masked, nothing, nothing, all_, params.mentions)):
            rows.append(own[told])
            prev.append(b[told])
            nxt.append(a[told])
            same.append(s[told])
            y.append(hot[told])
            weight.append(np.full(int(told.sum()), float(w)))
    field = Field(np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k))
    if not rows:
        field.unary[0, NONE] = 10.0
        return field
    x, prev, nxt, same, y, weight = (np.concatenate(a) for a in (rows, prev, nxt, same, y, weight))
    speed = [np.zeros_like(field.unary), np.zeros_like(field.chain), np.zeros_like(field.skip)]
    for _ in range(params.steps):
        p = _normal(x @ field.unary + prev @ field.chain + nxt @ field.chain.T + same * field.skip)
        error = (y - p) * weight[:, None]
        grads = [x.T @ error, prev.T @ error + (nxt.T @ error).T, (same * error).sum() * np.ones(k)]
        for s, g, w in zip(speed, grads, (field.unary, field.chain, field.skip), strict=True):
            s *= 0.9
            s += (g - params.ridge * w) / weight.sum()
            w += 0.5 * s
    field.skip = np.maximum(field.skip, 0)
    return field


def more_spans(text: str, base: list[Span], field: Field, params: CrfParams) -> list[Span]:
    """Runs of words outside the pattern spans to which the field surely gives one kind."""
    words, ties = words_of(text, base, params.core)
    if not any(w.label == NONE for w in words):
        return []
    x, near, tie, label = _graph(text, words, ties)
    p = field.beliefs(x, near, tie, np.where(label == NONE, -1, label), params.sweeps)
    best = np.where((label == NONE) & (p.max(axis=1) >= params.sure), p.argmax(axis=1), NONE)
    out: list[Span] = []
    for i, w in enumerate(words):
        if best[i] == NONE:
            continue
        a, b = w.start, w.end
        while a < b and not text[a].isalnum() and text[a] != "+":
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a == b:
            continue
        if out and i and near[i] and best[i - 1] == best[i] and out[-1][2] >= words[i - 1].start:
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((int(best[i]), a, b))
    return out


def train_field(docs: DataFrame, params: CrfParams = CrfParams(), text: str = "text") -> Field:
    """Fit on the different texts with a digit or @ of least hash, ``documents`` at most.

    How many there are says which share of the hashes' range holds about that many, so only
    those texts come to the driver, each once, however many partitions or copies there are.
    Texts over ``longest`` characters are left out of the sample (not of the search).
    """
    rows = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= params.longest)).withColumn("h", F.xxhash64("text"))
    number = rows.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 1.3 * params.documents / max(1, number))
    bound = min(2**63 - 1, int(-(2**63) + share * 2**64))
    sample = rows.where(F.col("h") <= F.lit(bound)).distinct().collect()
    chosen = sorted((r.h, r.text) for r in sample)[: params.documents]
    return fit_field([t for _, t in chosen], params)


def find_personal_data(docs: DataFrame, field: Field, params: CrfParams = CrfParams(), text: str = "text", key: str = "doc_id", redact: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    The numbers count pattern spans, of which base_sha256 is the hash; ``spans`` lists those
    and the field's, as kind:start:end by kind, then start (code points, end exclusive). With
    ``redact`` a column ``redacted`` follows: the text with every span's place taken by its
    kind in brackets (of overlapping spans, the leftmost, then the longest). Null texts are
    empty; repeated rows and null keys stay. No shuffle.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in by_size(texts, 4_000_000):
                rows = []
                for t in texts[i:j]:
                    base = base_spans(t)
                    every = sorted(base + more_spans(t, base, field, params)) if MARK.search(t) else base
                    said = [",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in s) for s in (base, every)]
                    row = [*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(said[0].encode()).hexdigest(), said[1]]
                    rows.append([*row, blanked(t, every)] if redact else row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    kinds = [pa.int64()] * 4 + [pa.string()] * (3 if redact else 2)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"][: 8 if redact else 7]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redact
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def blanked(text: str, spans: list[Span]) -> str:
    """The text with spans replaced by their kinds in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
            end = b
        elif b > end:  # an overlapping rest is personal data too
            end = b
    return "".join([*out, text[end:]])
