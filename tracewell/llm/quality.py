"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: each token has a sparse ternary index vector drawn from its hash, and a term's word
vector is the sum of its neighbours' index vectors. The vocabulary is the frequent tokens of the
training texts and a class for each other token's shape (letters, case, digits, marks, length), so that
unseen words have word vectors too. A document is pooled from vectors alone: the mean and the standard
deviation of its tokens' word vectors, the variance of their own index vectors, and the mean of its
bigrams' vectors, each the product of two neighbours' index vectors (binding). In the last two a text that
turns on few words, or says one again and again, differs from prose whatever its words are. A network
of one hidden layer, in numpy, is trained on that; its logit is divided by a temperature fitted on texts
that it hasn't seen.

Bounds: trained on TRAIN_DOCS labelled documents of at most TRAIN_CHARS characters, taken in the
order of a hash of their id; every whole text is scored.

Edge cases: a null text counts as empty and has a score as any text; a label that isn't 0 or 1, or
whose id no document has, teaches nothing; with labels of one kind only, or none, every score is that
kind's share (0.5 without labels); repeated rows get equal scores; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, map_batches, one_of, texts

TRAIN_DOCS, TRAIN_CHARS = 3000, 50_000
VOCABULARY, LEAST_COUNT = 4096, 5
DIM, NONZERO, NEAR = 64, 6, 2
#: Tokens that a process keeps, and tokens pooled at once.
MOST_TOKENS, PIECE = 1 << 17, 1 << 16
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 64, 3e-3, 1e-4, 7

TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    """The class of a token that the vocabulary lacks."""
    kind = "digits" if token.isdigit() else "mixed" if not token.isalpha() and token[:1].isalnum() else "marks" if not token[:1].isalnum() else "upper" if token.isupper() and len(token) > 1 else "title" if token[:1].isupper() else "lower"
    return f"\0{kind}{min(len(token), 12) // 3}"


def index_vectors(tokens: list[str]) -> np.ndarray:
    """A ternary vector for each token: NONZERO places and signs from the bits of its hash; a place drawn twice adds up or cancels."""
    digest = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), SEED) for t in tokens], np.uint64)
    out = np.zeros((len(tokens), DIM), np.float32)
    for k in range(NONZERO):
        place = (digest >> np.uint64(6 * k)) & np.uint64(DIM - 1)
        sign = (digest >> np.uint64(6 * NONZERO + k)) & np.uint64(1)
        out[np.arange(len(tokens)), place.astype(np.int64)] += np.where(sign, 1, -1)
    return out


class Lexicon:
    """What a process has looked up: a number for each token, its term and its index vector; begun anew beyond MOST_TOKENS."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.term, self.index = np.zeros(1 << 12, np.int32), np.zeros((1 << 12, DIM), np.float32)

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.numbers) > MOST_TOKENS:
            self.clear()
        new = list(dict.fromkeys(t for t in tokens if t not in self.numbers))
        if new:
            first, end = len(self.numbers), len(self.numbers) + len(new)
            while end > len(self.term):
                self.term, self.index = np.concatenate([self.term, np.zeros_like(self.term)]), np.concatenate([self.index, np.zeros_like(self.index)])
            self.numbers.update(zip(new, range(first, end)))
            self.term[first:end] = [self.terms[t] if t in self.terms else self.terms.get(shape(t), 0) for t in new]
            self.index[first:end] = index_vectors(new)
        return np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))


@dataclass
class QualityModel:
    terms: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    constant: float | None = None

    def features(self, text: str | None, known: Lexicon) -> np.ndarray:
        """The pooled vector of a text."""
        tokens = TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(4 * DIM, np.float32)
        ids = known.ids(tokens)
        counts = np.bincount(known.term[ids], minlength=len(self.vectors))
        used = np.flatnonzero(counts)
        share = (counts[used] / len(ids)).astype(np.float32)
        mean = share @ self.vectors[used]
        spread = np.sqrt(np.maximum(share @ self.vectors[used] ** 2 - mean**2, 0))
        total, squares, bound = np.zeros((3, DIM))
        for at in range(0, len(ids), PIECE):
            own = known.index[ids[at : at + PIECE + 1]]  # a piece's last bigram ends in the next one
            here, ones = own[:PIECE], np.ones(len(own), np.float32)  # products with ones are the fastest sums
            total += ones[: len(here)] @ here
            squares += ones[: len(here)] @ (here * here)
            bound += ones[1:] @ (own[1:] * own[:-1])
        n = len(ids)
        return np.concatenate([mean, spread, squares / n - (total / n) ** 2, bound / n]).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(batch), self.constant)
        z = self.logits(np.stack(batch)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _word_vectors(corpus: list[str]) -> tuple[dict[str, int], np.ndarray]:
    counts: Counter[str] = Counter()
    for text in corpus:
        counts.update(TOKEN.findall(text))
    kept = sorted((t for t, n in counts.items() if n >= LEAST_COUNT), key=lambda t: (-counts[t], t))[:VOCABULARY]
    names = sorted({shape(t) for t in counts})
    terms = {t: n for n, t in enumerate(["\0", *names, *kept])}
    index = index_vectors(list(terms))
    vectors = np.zeros_like(index)
    for text in corpus:
        ids = np.array([terms[t] if t in terms else terms[shape(t)] for t in TOKEN.findall(text)], np.int64)
        for step in range(1, NEAR + 1):
            np.add.at(vectors, ids[step:], index[ids[:-step]])
            np.add.at(vectors, ids[:-step], index[ids[step:]])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return terms, vectors / np.maximum(norm, 1e-9)


def _network(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights and biases by Adam on cross-entropy; both kinds of label weigh alike only as far as they are frequent."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            xb, yb = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            hidden = np.maximum(xb @ layers[0] + layers[1], 0)
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -60, 60))) - yb[:, None]) / len(xb)
            back = (wrong @ layers[2].T) * (hidden > 0)
            step += 1
            for k, g in enumerate((xb.T @ back + DECAY * layers[0], back.sum(0), hidden.T @ wrong + DECAY * layers[2], wrong.sum(0))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                layers[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(w.astype(np.float32) for w in layers)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, of a grid from 1/4 to 8."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, -(2 * y - 1) * z / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(examples: list[tuple[str, int]]) -> QualityModel:
    """A model of (text, 0 or 1); a fifth of the examples only sets the temperature."""
    y = np.array([q for _, q in examples], np.float64)
    none = np.zeros((0, 0))
    if len(set(y)) < 2:
        return QualityModel({}, none, none, none, (), 1.0, float(y.mean()) if len(y) else 0.5)
    aside = np.arange(len(y)) % 5 == 4
    terms, vectors = _word_vectors([t for (t, _), a in zip(examples, aside) if not a])
    model = QualityModel(terms, vectors.astype(np.float32), none, none, (), 1.0)
    known = Lexicon(terms)
    x = np.stack([model.features(t, known) for t, _ in examples])
    model.mean, model.scale = x[~aside].mean(0), x[~aside].std(0) + 1e-3
    model.layers = _network(((x - model.mean) / model.scale)[~aside], y[~aside])
    if aside.any():
        model.temperature = _temperature(model.logits(x[aside]).astype(np.float64), y[aside])
    return model


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on labelled documents that aren't held out, TRAIN_DOCS of them at most."""
    taught = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    few = taught.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(order, "doc_id", "quality").limit(TRAIN_DOCS)
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").filter(F.length("text") <= TRAIN_CHARS)  # TRAIN_DOCS rows
    rows = found.orderBy(order, "doc_id", "quality", "text").limit(TRAIN_DOCS).select("text", "quality").toLocalIterator()
    return fit([(r.text, r.quality) for r in rows])


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs' columns and ``score``, the calibrated probability of label 1."""
    return _scored(docs, model, one_of("score", docs.columns))


def _scored(docs: DataFrame, model: QualityModel, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY vectors
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(sent.value.terms)
        for batch in batches:
            features = [sent.value.features(text, known) if sent.value.constant is None else None for text in texts(batch.column(at))]
            scores = sent.value.scores(features) if features else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    plain = docs.toDF(*(f"c{n}" for n in range(len(docs.columns))))  # names may hold what a reference can't
    return map_batches(plain, run, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*docs.columns, name)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rated = _scored(docs.select("doc_id", "text"), train(docs, labels), "score")
    return rated.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the documents whose score is under a half."""
    name = one_of("score", docs.columns)
    return _scored(docs, train(docs, labels), name).filter(F.col(name) >= 0.5).drop(name)
