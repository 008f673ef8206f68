"""Quality classifier: naive Bayes support vectors.

A text becomes indicators of n-grams: of its words (one and two), of its words' shapes
(one to three) and of buckets of how many words, distinct word triples and distinct lines it
has. An indicator is hashed to one of 2**BITS features. Each feature is scaled by its class
log-count ratio, rows are brought to unit length, and a linear model with hinge loss is
fitted by dual coordinate descent; its weights are then drawn towards their mean
magnitude, as naive Bayes support vectors do. Margins of folds that were left out give
the logistic curve that turns a margin into a score between 0 and 1.

The model is fitted on FIT_ROWS labelled rows at most, those with the least hash of
doc_id, so that the driver holds a bounded sample; every document is scored. What is
shipped are two arrays of 2**BITS numbers. Documents are never shuffled.

Defined cases: null and empty texts have only bucket indicators and get a score like any
other; labels without a document, null labels and null ids teach nothing; several labels
of a document count as their mean, 0.5 as good; without labels of both classes the score
is the smoothed share of good labels for all; repeated rows get equal scores; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_batches, lower_space_words, space_words

BITS, FIT_ROWS, FOLDS, THRESHOLD = 20, 12_000, 3, 0.3

_CLASS = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_WORDS_KEPT = 300_000


def shape(word: bytes) -> bytes:
    """The word's kinds of characters, runs as one: 'The!!' gives 'Aa!'."""
    return _RUN.sub(rb"\1", word.translate(_CLASS))[:12]


class Indicators:
    """Rising feature numbers of a text."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.known: dict[bytes, tuple[int, int]] = {}

    def _look(self, word: bytes) -> tuple[int, int]:
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        got = self.known[word] = (xxhash.xxh3_64_intdigest(lower_space_words(word)[0]), xxhash.xxh3_64_intdigest(shape(word), seed=1))
        return got

    def __call__(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        words = space_words(text)
        n = len(words)
        parts = []
        triples = 0
        if n:
            known = self.known
            pairs = np.array([known.get(w) or self._look(w) for w in words], np.uint64)
            w, s = pairs[:, 0], pairs[:, 1]
            parts = [w, s]
            if n > 1:
                parts += [w[:-1] * _K[0] + w[1:], s[:-1] * _K[1] + s[1:]]
            if n > 2:
                triple = (w[:-2] * _K[1] + w[1:-1]) * _K[0] + w[2:]
                triples = len(np.unique(triple)) / len(triple)
                parts.append((s[:-2] * _K[2] + s[1:-1]) * _K[0] + s[2:])
        lines = text.split(b"\n")
        buckets = (n.bit_length() * 2 + (n >> max(0, n.bit_length() - 2) & 1), 32 + int(8 * triples), 64 + int(8 * len(set(lines)) / len(lines)))
        h = np.concatenate([*parts, np.array(buckets, np.uint64) * _K[3]])
        h = (h ^ (h >> np.uint64(31))) * _K[0]
        return np.unique((h ^ (h >> np.uint64(29))) * _K[1] >> self.shift).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset))); margin = sum of weights over the norm of ratios."""

    weights: np.ndarray
    squares: np.ndarray
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(self.squares[features].sum() + 1e-12))

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k] or [np.empty(0, np.int32)]), minlength=size) + smooth for k in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], scaled: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, size: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Weights of least norm plus hinge loss: one dual variable at a time, to its best value in [0, cost]."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(v @ v) for v in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            if norms[i] == 0:
                continue
            gradient = signs[i] * float(scaled[i] @ w[rows[i]]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            if (step := new - alpha[i]) != 0:
                w[rows[i]] += step * signs[i] * scaled[i]
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w


def _fit_once(rows, labels, size, cost, towards_mean):
    ratios = log_count_ratios(rows, labels, size)
    scaled = [(v := ratios[r]) / (np.sqrt(v @ v) + 1e-12) for r in rows]
    share = labels.mean()
    costs = np.where(labels == 1, cost, cost * min(10.0, share / (1 - share)) if share > 0.5 else cost)
    w = dual_coordinate_descent(rows, scaled, np.where(labels == 1, 1.0, -1.0), costs, size)
    used = w[w != 0]
    mean = np.abs(used).mean() if len(used) else 0.0
    w = np.where(w != 0, (1 - towards_mean) * w + towards_mean * mean * np.sign(w), 0.0)
    return (w * ratios).astype(np.float32), (ratios * ratios).astype(np.float32)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with targets drawn in by one observation a class."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - p))
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int = 2**BITS, cost: float = 1.0, towards_mean: float = 0.25) -> Model:
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        none = np.zeros(size, np.float32)
        good = float(labels.sum())
        return Model(none, none, 0.0, float(np.log((good + 1) / (len(labels) - good + 1))))
    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        learn = np.flatnonzero(fold != k)
        if len(set(labels[learn].tolist())) < 2:
            continue
        part = Model(*_fit_once([rows[i] for i in learn], labels[learn], size, cost, towards_mean), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(rows[i])
    slope, offset = _logistic(margins, labels)
    if slope <= 0:  # too few rows to tell; keep the order of margins
        slope, offset = 1.0, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    return Model(*_fit_once(rows, labels, size, cost, towards_mean), slope, offset)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from labelled documents that are not held out: `rows` of them at most."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    order = F.xxhash64(F.col("doc_id").cast("long"))
    sample = known.where(~held_out()).orderBy(order, "doc_id").limit(rows).select(F.col("doc_id").alias("label_id"), "label")
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # `rows` short rows

    def make():
        features = Indicators()
        return lambda texts: [[features(t).tobytes() for t in texts]]

    got = append_columns(found.select("doc_id", "text", "label"), "text", [T.StructField("features", T.BinaryType())], make)
    table = got.select("doc_id", "label", "features").orderBy(order, F.xxhash64("features")).limit(rows).toArrow()
    return fit([np.frombuffer(b, np.int32) for b in table.column("features").to_pylist()], np.array(table.column("label").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features, model = Indicators(), shipped.value
        return lambda texts: [[model.score(features(t)) for t in texts]]

    scored = append_columns(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", [T.StructField("score", T.DoubleType())], make)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


