"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each text gives a set of n-grams: 4-grams of character classes, word 1- and 2-grams, and
marks for a word that repeats the one before and for a line that occurred before.  Indicators
are scaled by the log-count ratio of the two classes, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent.  Margins of held-out folds give
the logistic curve that makes a score of them.

The model is fitted on at most about `SAMPLE` labelled rows with at most about `SAMPLE_GRAMS`
n-grams in all, chosen by a hash of doc_id, so the driver's memory is bounded for long texts, too;
all documents are scored, whole, in one pass without an exchange.  Labels, lang, source and
doc_id are no inputs of a score.

Defined cases: null and empty texts have no n-grams and get the score of the bias; null
doc_id is not held out and never labelled; several labels of a document each count; without
labels of both classes all scores are the share of label 1, or 0.5 without labels; an empty table gives none; extra
columns stay as they are, in a clash ours gets an underscore.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, materialised, read_table, slice_hashes

#: Labelled rows that a model is fitted on, about, and n-grams of them, 4 bytes each.
SAMPLE, SAMPLE_GRAMS = 8_000, 16_000_000
#: A document is predicted good from this score on.
THRESHOLD = 0.7
_BITS = 20
#: Indicators: classes of 4 characters, hashes of words and word pairs, two marks.
N_FEATURES = (2 << _BITS) + 2

#: Characters that are a class each; then digits, small and capital letters, blanks, line ends,
#: all beyond ASCII, and all others.
_OWN = "#*$%&|<>!?.,:;\"'()-_=/+@"
_CLASS = np.full(256, 31, np.uint32)
for _i, _c in enumerate(_OWN):
    _CLASS[ord(_c)] = _i
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = 25, 26, 27, 26
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]] = 28, 29

def features(text: str | None) -> np.ndarray:
    """Ascending numbers of the text's n-grams."""
    codes = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(codes):
        return np.zeros(0, np.int64)
    cls = _CLASS[codes]
    out = []
    if len(cls) >= 4:
        out.append((cls[:-3] << 15 | cls[1:-2] << 10 | cls[2:-1] << 5 | cls[3:]).astype(np.int64))
    gap = (codes <= 32) & ((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts):
        h = slice_hashes(codes, starts, ends)
        mask = np.uint64((1 << _BITS) - 1)
        with np.errstate(over="ignore"):
            pairs = h[:-1] * np.uint64(31) + h[1:]
        words = np.concatenate((h, pairs)) & mask
        out.append(words.astype(np.int64) + (1 << _BITS))
        if (h[1:] == h[:-1]).any():
            out.append(np.array([2 << _BITS]))
        breaks = np.flatnonzero(codes == 10)
        a, b = np.append(0, breaks + 1), np.append(breaks, len(codes))
        full = b - a > 1
        if full.sum() > 1:
            lines = slice_hashes(codes, a[full], b[full])
            if len(np.unique(lines)) < len(lines):
                out.append(np.array([(2 << _BITS) + 1]))
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return np.unique(found.astype(np.int32)).astype(np.int64)


class Model:
    """score = logistic(a * margin + b); weights hold the ratios already."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.squares, self.bias, self.a, self.b = weights, squares, bias, a, b

    def margin(self, ids: np.ndarray) -> float:
        if not len(ids):
            return self.bias
        return float(self.weights[ids].sum() / np.sqrt(self.squares[ids].sum() + 1e-12)) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(features(text)) + self.b, -30, 30))))


def _descend(flat: np.ndarray, ends: np.ndarray, which: np.ndarray, ratio: np.ndarray, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the hinge loss over rows of unit length and a bias of 1, which
    is the last weight.  Row i's values are made anew each time; only n-grams are held."""
    n = len(ratio)
    w, alpha = np.zeros(n + 1), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(which):
            ids = flat[ends[i] : ends[i + 1]]
            v = ratio[ids] * scale[i]
            slope = y[i] * (float(w[ids] @ v) + w[n]) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[ids] += step * v
                w[n] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, folds: int = 3, seed: int = 7) -> Model | float:
    """The model, or a constant score where the labels are of one class."""
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if len(rows) else np.zeros(0, np.int32)
    return fit_packed(flat, np.array([len(r) for r in rows], np.int64), labels, cost, epochs, folds, seed)


def fit_packed(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 12, folds: int = 3, seed: int = 7) -> Model | float:
    """As `fit`, for the n-grams of all rows one after the other."""
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.5
    used = np.flatnonzero(np.bincount(flat, minlength=N_FEATURES))
    place = np.zeros(N_FEATURES, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    flat, ends = place[flat], np.concatenate(([0], np.cumsum(sizes)))
    row = lambda i: flat[ends[i] : ends[i + 1]]
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, (labels == 1).sum(), (labels != 1).sum())
    each = cost * len(y) / (2 * share)

    def train(which: np.ndarray):
        good, bad = np.ones(len(used)), np.ones(len(used))
        for i in which:
            (good if y[i] > 0 else bad)[row(i)] += 1
        ratio = np.log((good / good.sum()) / (bad / bad.sum()))
        scale = np.array([1 / np.sqrt((ratio[row(i)] ** 2).sum() + 1e-12) for i in range(len(y))])
        return _descend(flat, ends, which, ratio, scale, y, each, epochs, seed), ratio, scale

    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    margins = np.zeros(len(y))
    for k in range(folds):
        w, ratio, scale = train(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margins[i] = w[row(i)] @ ratio[row(i)] * scale[i] + w[-1]
    a, b = _logistic(margins, labels)
    w, ratio, _ = train(np.arange(len(y)))
    weights, squares = np.zeros(N_FEATURES, np.float32), np.zeros(N_FEATURES, np.float32)
    weights[used], squares[used] = w[:-1] * ratio, ratio**2
    return Model(weights, squares, float(w[-1]), a, b)


def _logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift by damped Newton steps, with targets a little off 0 and 1."""
    good = (labels == 1).sum()
    bad = len(labels) - good
    t = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, v = p - t, p * (1 - p) + 1e-9
        g = np.array([d @ margins, d.sum()])
        hess = np.array([[v @ margins**2 + 1e-6, v @ margins], [v @ margins, v.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - min(1.0, 2 / (np.abs(step).max() + 1e-9)) * step[0], b - min(1.0, 2 / (np.abs(step).max() + 1e-9)) * step[1]
    return max(a, 1e-3), b


def held_out(doc_id):
    """Rows whose labels nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, grams_at_most: int = SAMPLE_GRAMS) -> Model | float:
    """Fits on labelled rows that aren't held out.  Only n-grams of the sample come to the driver."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out("doc_id"))
    there = known.count()
    if there > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / there))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about `sample` rows

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [features(t).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(ids, pa.binary())], names=["doc_id", "y", "ids"])

    found = materialised(chosen.mapInArrow(grams, "doc_id long, y int, ids binary"), "grams")
    there = (found.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 4
    if there > grams_at_most:
        found = found.where(F.pmod(F.xxhash64(F.lit("grams"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * grams_at_most / there))
    rows = found.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("ids", "ascending")])
    y, ids = rows.column("y").to_numpy(), rows.column("ids")
    sizes = np.array([len(x.as_buffer()) // 4 if x.is_valid else 0 for x in ids], np.int64)
    flat = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in ids]) if len(ids) else np.zeros(0, np.int32)
    del rows, ids
    return fit_packed(flat, sizes, y)


_MODELS: dict = {}


def score_documents(docs: DataFrame, model: Model | float, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The documents with two more columns, named by the caller; a name that they have already
    gets underscores in front, as `free_name` does."""
    score, predicted = free_name(docs, score), free_name(docs, predicted)
    if isinstance(model, float):
        scored = docs.withColumn(score, F.lit(model))
    else:
        held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
        key = uuid.uuid4().hex  # of this model in the workers, which keep one

        def score_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if key not in _MODELS:
                _MODELS.clear()
                _MODELS[key] = pickle.loads(held.value)
            m = _MODELS[key]
            for texts in batches:
                yield pd.Series([m.score(t) for t in texts], dtype=float)

        score_texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        scored = docs.withColumn(score, F.pandas_udf(score_texts, "double")(F.col(text_col)))
    return scored.withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))


def op7_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted"
    )


QUERIES = {"op7_nb_svm": op7_nb_svm}
ORACLES: dict[str, str] = {}
