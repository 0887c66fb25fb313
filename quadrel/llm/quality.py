"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Learned filters run
over every byte position; further channels say how well the last bytes repeat those a few
places earlier, which shows repeated words whatever they are. Each filter and channel is
max-pooled over a chunk, a small dense head gives the chunk's logit, and the document's
logit is the mean of its chunks', scaled on the training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import by_size, held_out, labelled_sample


@dataclass(frozen=True)
class ConvParams:
    chunk: int = 1024  # window starts a chunk; its last windows reach into the next chunk
    width: int = 6  # bytes a filter sees
    filters: int = 16
    embedding: int = 8
    hidden: int = 12
    lags: tuple[int, ...] = tuple(range(2, 18))
    run: int = 24  # bytes over which repeats at a lag are averaged
    per_class: int = 1500  # training documents of each class, at most
    epochs: int = 6
    steps: int = 700  # at least, however few the training rows
    crops: int = 700  # short pieces of each class's training documents, added to them
    batch: int = 64
    rate: float = 0.01
    seed: int = 11


class ByteNetwork:
    """The network's weights, its training and its scores. Picklable, some 20 kB."""

    def __init__(self, params: ConvParams = ConvParams()):
        p, rng = params, np.random.default_rng(params.seed)
        self.params = p
        features = p.filters + len(p.lags)
        self.weights = {
            "emb": rng.normal(0, 0.3, (256, p.embedding)),
            "conv": rng.normal(0, 1 / np.sqrt(p.width * p.embedding), (p.width, p.embedding, p.filters)),
            "bias": np.zeros(p.filters),
            "w1": rng.normal(0, 1 / np.sqrt(features), (features, p.hidden)),
            "b1": np.zeros(p.hidden),
            "w2": rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden),
            "b2": np.zeros(1),
        }
        self.scale, self.shift = 1.0, 0.0

    def _layout(self, texts: list[str]):
        """All bytes with a gap of zeros after each text; the places where windows start, chunk
        by chunk (starts, ends); the chunks of each text. No window or run spans the gap."""
        p = self.params
        gap = max(p.width, p.run, max(p.lags)) + 1
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer((b"\0" * gap).join(data) + b"\0" * (2 * gap), np.uint8)
        sizes = np.array([len(d) for d in data])
        begin = np.r_[0, np.cumsum(sizes + gap)][:-1]
        chunks = np.maximum(1, -(-sizes // p.chunk))
        first = np.r_[0, np.cumsum(chunks)]
        owner = np.repeat(np.arange(len(texts)), chunks)
        starts = begin[owner] + (np.arange(first[-1]) - first[owner]) * p.chunk
        ends = np.maximum(np.minimum(starts + p.chunk, (begin + sizes)[owner]), starts + 1)
        return raw, starts, ends, first

    def _repeats(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(chunks, lags): the largest share of a run of bytes that equal those one lag before."""
        p = self.params
        out = np.empty((len(starts), len(p.lags)), np.float32)
        bounds = np.stack([starts, ends], axis=1).ravel()
        for n, lag in enumerate(p.lags):
            same = np.zeros(len(raw) + p.run, np.uint8)
            same[lag : len(raw)] = (raw[lag:] == raw[:-lag]) & (raw[lag:] != 0)
            total = np.cumsum(same, dtype=np.int32)
            run = (total[p.run :] - total[: -p.run])[: len(raw)]  # run[i]: places i+1 .. i+run
            out[:, n] = np.maximum.reduceat(run, bounds)[::2]
        return out / np.float32(p.run)

    def _filtered(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(chunks, filters): the largest response to any window that starts in the chunk.

        An embedding times a filter is a table of 256 rows for each place of the window, so a
        response is a sum of ``width`` table rows.
        """
        p, w = self.params, self.weights
        tables = np.einsum("be,kef->kbf", w["emb"], w["conv"]).astype(np.float32)
        out = np.empty((len(starts), p.filters), np.float32)
        step = 128  # chunks at a time, about 130,000 positions
        for i in range(0, len(starts), step):
            j = min(i + step, len(starts))
            a, b = starts[i], ends[j - 1] + 1  # one place more, for the last end
            value = tables[0][raw[a:b]]
            for k in range(1, p.width):
                value += tables[k][raw[a + k : b + k]]
            bounds = np.stack([starts[i:j], ends[i:j]], axis=1).ravel() - a
            out[i:j] = np.maximum.reduceat(value, bounds, axis=0)[::2]
        return out + w["bias"].astype(np.float32)

    def _head(self, conv: np.ndarray, repeats: np.ndarray):
        w = self.weights
        x = np.concatenate([np.maximum(conv, 0), repeats], axis=1)
        h = np.tanh(x @ w["w1"] + w["b1"])
        return x, h, h @ w["w2"] + w["b2"][0]

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean of each text's chunk logits. An empty text is one chunk of zeros."""
        if not texts:
            return np.zeros(0)
        raw, starts, ends, first = self._layout(texts)
        chunk = self._head(self._filtered(raw, starts, ends), self._repeats(raw, starts, ends))[2]
        return np.add.reduceat(chunk, first[:-1]) / np.diff(first)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -40, 40)))

    def _with_crops(self, texts: list[str], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Short pieces teach the scores of short documents: a piece of a good text is good
        at any length, junk needs some length to show."""
        rng, out, marks = np.random.default_rng(self.params.seed + 2), list(texts), list(labels)
        for label, low, high in ((1, 8, 300), (0, 140, 500)):
            own = [t for t, y in zip(texts, labels, strict=True) if y == label and len(t) > low]
            for n in range(self.params.crops if own else 0):
                text = own[n % len(own)]
                size = min(len(text), int(np.exp(rng.uniform(np.log(low), np.log(high)))))
                at = int(rng.integers(0, len(text) - size + 1))
                out.append(text[at : at + size])
                marks.append(label)
        return out, np.array(marks, float)

    def fit(self, texts: list[str], labels: list[int]) -> ByteNetwork:
        """Adam on chunks with their document's label, classes weighted alike; then a
        one-dimensional logistic fit of the documents' mean logits."""
        p, w = self.params, self.weights
        y_doc = np.array(labels, float)
        if len(set(labels)) < 2:  # nothing to tell apart
            self.scale, self.shift = 0.0, 4.0 if not labels or labels[0] else -4.0
            return self
        texts, y_doc = self._with_crops(texts, y_doc)
        raw, starts, ends, first = self._layout(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        repeats = self._repeats(raw, starts, ends)
        span = p.chunk + p.width - 1
        padded = np.r_[raw, np.zeros(span, np.uint8)]
        weight = np.where(y_doc == 1, 1 / max(1, y_doc.sum()), 1 / max(1, (1 - y_doc).sum()))[owner] / np.diff(first)[owner]
        weight = weight / weight.mean()
        rng = np.random.default_rng(p.seed + 1)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step = 0
        places = np.arange(span)
        batches = max(1, len(starts) // p.batch)
        for _ in range(max(p.epochs, -(-p.steps // batches))):
            for rows in np.array_split(rng.permutation(len(starts)), batches):
                x = padded[np.minimum(starts[rows][:, None] + places, len(padded) - 1)]
                emb = w["emb"].astype(np.float32)[x]
                seen = np.lib.stride_tricks.sliding_window_view(emb, p.width, axis=1)  # batch, place, e, width
                kernel = w["conv"].astype(np.float32)
                value = sum(emb[:, k : k + p.chunk] @ kernel[k] for k in range(p.width))
                inside = np.arange(p.chunk)[None, :] < (ends[rows] - starts[rows])[:, None]
                value[~inside] = -1e9
                best = value.argmax(axis=1)  # batch, filters
                conv = np.take_along_axis(value, best[:, None, :], axis=1)[:, 0] + w["bias"]
                feat, hidden, logit = self._head(conv, repeats[rows])
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y_doc[owner[rows]]) * weight[rows] / len(rows)
                grad = {"w2": hidden.T @ error, "b2": np.array([error.sum()])}
                back = np.outer(error, w["w2"]) * (1 - hidden**2)
                grad["w1"], grad["b1"] = feat.T @ back, back.sum(axis=0)
                back = (back @ w["w1"].T)[:, : p.filters] * (conv > 0)
                grad["bias"] = back.sum(axis=0)
                windows = seen[np.arange(len(rows))[:, None], best]  # batch, filters, e, width
                grad["conv"] = np.einsum("bf,bfek->kef", back, windows)
                spread = np.einsum("bf,kef->bfke", back, w["conv"])
                byte = x[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(p.width)]
                grad["emb"] = np.zeros_like(w["emb"])
                np.add.at(grad["emb"], byte.ravel(), spread.reshape(-1, p.embedding))
                step += 1
                for k, g in grad.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w[k] = w[k] - p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        z = self.logits(texts)
        balance = np.where(y_doc == 1, 0.5 / y_doc.mean(), 0.5 / (1 - y_doc.mean()))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps with a small ridge towards scale 1
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, h = (q - y_doc) * balance, np.maximum(q * (1 - q), 1e-6) * balance
            g = np.array([r @ z + 0.1 * (a - 1), r.sum()])
            hess = np.array([[h @ (z * z) + 0.1, h @ z], [h @ z, h.sum() + 1e-3]])
            da, db = np.linalg.solve(hess, g)
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        self.scale, self.shift = float(a), float(b)
        return self


def train_quality(docs: DataFrame, labels: DataFrame, params: ConvParams = ConvParams()) -> ByteNetwork:
    """Fit on at most ``per_class`` labelled documents a class, outside the held-out quarter."""
    return ByteNetwork(params).fit(*labelled_sample(docs, labels, "quality", params.per_class))


def score_quality(docs: DataFrame, network: ByteNetwork, threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text decides the score.

    Null texts are empty and get a score too; repeated rows and null keys stay. The model is
    some 20 kB in the task's closure; there is no shuffle, and a task holds a few megabytes
    of text at a time, or one text.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in by_size(texts, 4_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(network.score(texts[i:j]).astype(np.float64))], ["doc_id", "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
