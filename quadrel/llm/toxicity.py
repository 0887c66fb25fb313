"""Toxicity by weak supervision.

Lexicon and pattern voters say toxic, clean or nothing about a text. A generative label
model, fitted by expectation maximisation without labels, estimates how often each voter
says what about either class, and the correlations beyond that: a vote depends on the class
and on the votes of correlated voters. Its posterior labels train a linear classifier on what
the voters saw, and that classifier scores every whole text.

Labels are used for one thing: to mine the lexicons, on a bounded sample of training rows.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import by_size, held_out, labelled_sample
from quadrel.llm.jaccard import JaccardParams, signatures

# Common English insults.
INSULTS = {
    "stupidity": "idiot idiots idiotic moron morons stupid dumb imbecile fool fools retard retarded".split(),
    "contempt": "loser losers pathetic worthless useless clown trash garbage scum filth filthy vermin".split(),
    "disgust": "disgusting revolting repulsive ugly".split(),
    "profanity": "fuck fucking shit shitty bitch bastard asshole crap damn".split(),
}
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‚‘’…–—¡¿"


@dataclass(frozen=True)
class VoterParams:
    per_class: int = 5000  # labelled documents of each class that lexicons are mined from
    stems: tuple[int, ...] = (4, 5, 6, 7)  # lengths of word beginnings that may be terms
    groups: int = 4  # lexicon voters of each kind of term
    lift: float = 40.0  # least ratio of a term's document rates in toxic and clean texts
    chance: float = 1e-6  # most likely chance of a term's toxic count at its clean rate
    folds: int = 3
    iterations: int = 40
    parents: int = 1  # other voters that a vote may depend on (least log loss of 1 to 4, on training rows of other folds)
    dependence: float = 0.005  # least mutual information (nats) of two voters that depend on each other
    seed: int = 5


@dataclass
class Voters:
    """Terms by kind: "word" holds whole words, "stem4" beginnings of four letters, and so on.
    A term's voter is one of ``groups`` of its kind. Fixed insults have voters of their own."""

    params: VoterParams
    terms: dict[str, set[str]] = field(default_factory=dict)
    known: dict = field(default_factory=dict, repr=False)

    def names(self) -> list[str]:
        mined = [f"{kind}/{g}" for kind in ["word", *(f"stem{n}" for n in self.params.stems)] for g in range(self.params.groups)]
        return [*INSULTS, *mined]

    def patterns(self) -> list[str]:
        return ["two terms", "term share", "no mined word", "no stem", "no insult"]

    def pieces(self, word: str) -> list[tuple[str, str]]:
        return [] if not word else [("word", word), *((f"stem{n}", word[:n]) for n in self.params.stems if len(word) > n)]

    def _say(self, word: str) -> tuple[int, ...] | None:
        """Voters that a raw word sets off, or None."""
        bare = word.lower().strip(STRIP)
        names = self._index
        hits = [names[name] for name, own in self._insults if bare in own]
        for kind, piece in self.pieces(bare):
            if piece in self.terms.get(kind, ()):
                hits.append(names[f"{kind}/{zlib.crc32(piece.encode()) % self.params.groups}"])
        return tuple(hits) or None

    def prepare(self) -> Voters:
        self._index = {name: i for i, name in enumerate(self.names())}
        self._insults = [(name, frozenset(words)) for name, words in INSULTS.items()]
        self.known = {}
        return self

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, voters) numbers of distinct words that set a lexicon voter off; and the
        number of distinct words of each text. Seen words are remembered, up to a bound."""
        out = np.zeros((len(texts), len(self.names())), np.float32)
        sizes = np.zeros(len(texts), np.float32)
        for i, text in enumerate(texts):
            words = set(text.split())
            sizes[i] = len(words)
            if len(self.known) > 600_000:
                self.known.clear()
            known = self.known
            for word in words:
                if word not in known:
                    known[word] = self._say(word)
            found = [h for hits in filter(None, map(known.__getitem__, words)) for h in hits]
            if found:
                out[i] = np.bincount(found, minlength=out.shape[1])
        return out, sizes

    def votes(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(texts, voters): 1 toxic, -1 clean, 0 nothing; lexicons first, then patterns."""
        fixed, mined = len(INSULTS), len(self.names())
        words = slice(fixed, fixed + self.params.groups)
        stems = slice(fixed + self.params.groups, mined)
        total = counts[:, :fixed].sum(axis=1) + counts[:, words].sum(axis=1)
        stem = counts[:, stems].sum(axis=1)
        either = np.maximum(total, stem / max(1, len(self.params.stems)))
        rules = [
            np.where(either >= 2, 1, 0),
            np.where(either / np.maximum(sizes, 1) > 0.002, 1, np.where(either == 0, -1, 0)),
            np.where(counts[:, words].sum(axis=1) == 0, -1, 0),
            np.where(stem == 0, -1, 0),
            np.where(counts[:, :fixed].sum(axis=1) == 0, -1, 0),
        ]
        return np.concatenate([(counts > 0).astype(np.int8), np.stack(rules, axis=1).astype(np.int8)], axis=1)

    def features(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.log1p(counts), self.votes(counts, sizes)], axis=1).astype(np.float64)


def poisson_tail(n: int, mean: float) -> float:
    """P(X >= n) of a Poisson number, by its first terms (n is above the mean here)."""
    term = math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))
    total, k = 0.0, n
    while term > total * 1e-9:
        total += term
        k += 1
        term *= mean / k
    return total


def mine(texts: list[str], labels: list[int], params: VoterParams) -> list[Voters]:
    """Lexicons of all texts, and of all but those of each fold (text i is in fold i modulo
    ``folds``): 1 + folds voters.

    Terms are those whose document rate in toxic texts is ``lift`` times that in clean ones or
    more, and that chance does not explain: their count in toxic texts must be a rare one
    (Poisson) at the rate that one more clean text with the term would mean. Toxic texts
    count by their different neighbours of the term, so a passage that many share counts once.

    Three passes keep the memory small: toxic texts are counted by hashes of terms, clean
    texts for frequent ones, and neighbours are kept for terms that may still pass.
    """
    shape, folds = Voters(params), params.folds
    numbers = np.zeros((folds, 2), int)
    for i, label in enumerate(labels):
        numbers[i % folds, label] += 1
    clean_all, toxic_all = np.maximum(numbers.sum(axis=0), 1)

    def passes(n: int, other: int, toxic: int, clean: int, ease: float = 1.0) -> bool:
        rate = n * ease / toxic >= params.lift * (other + 0.5) / clean
        return n >= 2 and rate and (ease > 1 or poisson_tail(n, toxic * (other + 1) / clean) <= params.chance)

    def pieces_of(text: str) -> set:
        return {p for w in {w.lower().strip(STRIP) for w in text.split()} for p in shape.pieces(w)}

    toxic_texts = [(i, t) for i, (t, label) in enumerate(zip(texts, labels, strict=True)) if label]
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(toxic_texts), 200):
        block = [np.fromiter(map(hash, pieces_of(t)), np.int64) for _, t in toxic_texts[start : start + 200]]
        merged, place = np.unique(np.concatenate([codes, *block]), return_inverse=True)
        weight = np.concatenate([counts, np.ones(sum(map(len, block)), np.int64)])
        codes, counts = merged, np.bincount(place, weight, len(merged)).astype(np.int64)
    # One fold less may raise a term's rate by half at most; neighbours only lower its count.
    often = {int(c): int(n) for c, n in zip(codes, counts, strict=True) if passes(n, 0, toxic_all, clean_all, 2.0)}
    seen = {c: [0] * folds for c in often}
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        if not label:
            for code in map(hash, pieces_of(text)):
                if code in seen:
                    seen[code][i % folds] += 1
    likely = {c for c, n in often.items() if passes(n, sum(seen[c]), toxic_all, clean_all, 2.0)}
    contexts: dict[tuple[str, str], list[set]] = {}
    for i, text in toxic_texts:
        words, met = text.split(), set()
        for at, word in enumerate(words):
            for piece in shape.pieces(word.lower().strip(STRIP)):
                if hash(piece) in likely and piece not in met:
                    met.add(piece)
                    context = hash((words[at - 1] if at else "", words[at + 1] if at + 1 < len(words) else ""))
                    contexts.setdefault(piece, [set() for _ in range(folds)])[i % folds].add(context)
    out = []
    for left_out in (None, *range(folds)):
        kept = [f for f in range(folds) if f != left_out]
        clean, toxic = np.maximum(numbers[kept].sum(axis=0), 1)
        voters = Voters(params)
        for piece, own in contexts.items():
            n, other = len(set().union(*[own[f] for f in kept])), sum(seen[hash(piece)][f] for f in kept)
            if passes(n, other, toxic, clean):
                voters.terms.setdefault(piece[0], set()).add(piece[1])
        out.append(voters.prepare())
    return out


@dataclass
class LabelModel:
    """A class, and votes that depend on it and on at most ``parents`` other voters each.

    ``parents`` (voters, parents) names the voters that a voter's vote depends on (-1: none);
    no voter depends on itself by way of others. ``rates`` are P(vote | class, parents' votes).
    The probability of a text's votes is the product of the prior and the rates.
    """

    rates: np.ndarray  # voters, class, parents' votes as a number of base 3, vote (-1, 0, 1)
    prior: float
    parents: np.ndarray

    def above(self, votes: np.ndarray) -> np.ndarray:
        """(texts, voters): the parents' votes, as a number of base 3."""
        place = votes.astype(int) + 1
        out = np.zeros(votes.shape, int)
        for column in self.parents.T:
            out = out * 3 + np.where(column >= 0, place[:, column], 1)
        return out

    def joint(self, votes: np.ndarray) -> np.ndarray:
        """(texts, class): log P(class, votes)."""
        index, above = np.arange(votes.shape[1]), self.above(votes)
        logs = [np.log(self.rates[index, c, above, votes.astype(int) + 1]).sum(axis=1) for c in (0, 1)]
        return np.stack(logs, axis=1) + np.log([1 - self.prior, self.prior])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = self.joint(votes)
        return 1 / (1 + np.exp(-np.clip(logs[:, 1] - logs[:, 0], -40, 40)))


def dependence(pairs: np.ndarray) -> np.ndarray:
    """(voters, voters): mutual information of two voters' votes within the classes, of
    ``pairs`` (class, voter, vote, voter, vote), weighted numbers of texts."""
    p = pairs / max(pairs[:, 0, :, 0, :].sum(), 1e-300)
    size = p[:, 0, :, 0, :].sum(axis=(1, 2))[:, None, None, None, None]
    first, second = p.sum(axis=4, keepdims=True), p.sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log(p * size / (first * second)), 0.0)
    return terms.sum(axis=(0, 2, 4))


def choose_parents(weights: np.ndarray, least: float, most: int) -> np.ndarray:
    """(voters, most): voters are taken one by one, the one that depends most on those taken
    first; its parents are up to ``most`` of them, of ``least`` dependence at least."""
    m = len(weights)
    out, taken = np.full((m, most), -1), np.zeros(m, bool)
    known = np.where(weights >= least, weights, 0.0)
    for _ in range(m):
        strongest = -np.sort(-np.where(taken, known, 0.0), axis=1)[:, :most].sum(axis=1)
        at = int(np.where(taken, -1.0, strongest).argmax())
        order = [j for j in np.argsort(-known[at], kind="stable") if taken[j] and known[at, j] > 0][:most]
        out[at, : len(order)] = order
        taken[at] = True
    return out


def fit_label_model(votes: np.ndarray, params: VoterParams) -> LabelModel:
    """Expectation maximisation from the voters' majority.

    Each M-step also finds the correlations: which other voters a vote depends on within the
    classes, by mutual information. What a voter only repeats after its parents adds no
    evidence. At first only near copies are tied, or they would outvote the others from the
    start; weaker dependences, which are the class itself while that is unsure, come later,
    down to ``dependence`` or what chance gives. From the middle of the steps on the parents
    stay as they are, which lets the rates converge.
    """
    n, m = votes.shape
    configs = 3**params.parents
    model = LabelModel(np.full((m, 2, configs, 3), 1 / 3), 0.5, np.full((m, params.parents), -1))
    if not n:
        return model
    said = (votes != 0).sum(axis=1)
    q = np.clip((votes.sum(axis=1) / np.maximum(said, 1) + 1) / 2, 0.05, 0.95)
    place = votes.astype(int) + 1
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64).reshape(n, 3 * m)
    middle = params.iterations // 2
    for step in range(params.iterations):
        weight = np.stack([1 - q, q])
        if step <= middle:
            pairs = np.stack([(onehot * w[:, None]).T @ onehot for w in weight]).reshape(2, m, 3, m, 3)
            least = max(params.dependence, 10 / n, 0.3 * 0.7**step)
            model.parents = choose_parents(dependence(pairs), least, params.parents)
        cell = model.above(votes) * 3 + place
        for j in range(m):
            counts = np.stack([np.bincount(cell[:, j], w, 3 * configs) for w in weight]).reshape(2, configs, 3)
            own = counts.sum(axis=1) + 0.2
            counts += own[:, None, :] / own.sum(axis=1)[:, None, None]  # smoothed by one text of the voter's own rates
            model.rates[j] = counts / counts.sum(axis=2, keepdims=True)
        # Voters are better than chance, whatever their parents say: toxic votes come more
        # from toxic texts, clean votes less.
        for vote, sign in ((2, 1), (0, -1)):
            wrong = sign * (model.rates[:, 1, :, vote] - model.rates[:, 0, :, vote]) < 0
            mean = model.rates[:, :, :, vote].mean(axis=1)
            for c in (0, 1):
                model.rates[:, c, :, vote] = np.where(wrong, mean, model.rates[:, c, :, vote])
        model.rates /= model.rates.sum(axis=3, keepdims=True)
        model.prior = float(np.clip(q.mean(), 0.01, 0.99))
        new = model.posterior(votes)
        if np.abs(new - q).max(initial=0) < 1e-6 and step > middle:
            break
        q = new
    return model


@dataclass
class ToxicityModel:
    voters: Voters
    label_model: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.voters.features(*self.voters.counts(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def without_copies(texts: list[str]) -> list[int]:
    """Indices of texts that share no MinHash band with an earlier kept one."""
    seen: set[int] = set()
    kept = []
    for i, j in by_size(texts, 3_000_000):
        for n, code in enumerate(signatures(texts[i:j], JaccardParams()).tolist(), i):
            bands = {b for b in code if b}
            if not bands & seen:
                kept.append(n)
                seen |= bands
    return kept


def fit_toxicity(texts: list[str], labels: list[int], params: VoterParams = VoterParams()) -> ToxicityModel:
    """Mine voters, fit the label model to their votes, and the classifier to its posterior.

    Of near copies in the sample one is used, else a copied text's words would all be terms.
    """
    kept = without_copies(texts)
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    # A lexicon flatters the texts it was mined from, so what voters say about a text is
    # learned from lexicons mined without it: a voter is the same kind and group of terms.
    voters, *without = mine(texts, labels, params)
    counts, sizes = np.zeros((len(texts), len(voters.names())), np.float32), np.zeros(len(texts), np.float32)
    for fold, other in enumerate(without):
        own = list(range(fold, len(texts), params.folds))
        if own:
            counts[own], sizes[own] = other.counts([texts[i] for i in own])
    votes = voters.votes(counts, sizes)
    model = fit_label_model(votes, params)
    target = model.posterior(votes) if len(texts) else np.zeros(0)
    x = voters.features(counts, sizes)
    weights, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(60 if len(texts) else 0):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        z = np.c_[x, np.ones(len(x))]
        ridge = np.r_[np.full(x.shape[1], 0.02 * len(x) ** 0.5), 1e-6]
        grad = z.T @ (p - target) + ridge * np.r_[weights, bias]
        hess = (z * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ z + np.diag(ridge)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        weights, bias = weights - step[:-1], bias - float(step[-1])
        if np.abs(step).max() < 1e-8:
            break
    if not len(texts):
        bias = -4.0
    voters.known = {}
    return ToxicityModel(voters, model, weights, bias)


def train_toxicity(docs: DataFrame, labels: DataFrame, params: VoterParams = VoterParams()) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents a class, outside the held-out quarter."""
    return fit_toxicity(*labelled_sample(docs, labels, "toxic", params.per_class), params)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text decides the score.

    Null texts are empty and get a score too; repeated rows and null keys stay. The lexicons
    travel in the task's closure (bounded by the sample); there is no shuffle.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in by_size(texts, 4_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(model.score(texts[i:j]).astype(np.float64))], ["doc_id", "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
