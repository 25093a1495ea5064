"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence, in the lower-cased whole text with white space as one mark, of n-grams of NGRAMS characters,
hashed to BUCKETS.  On a bounded sample of labelled rows (PER_CLASS of each class, taken by a hash of the id) each
feature's ratio r = log((p+1)/|p|) - log((q+1)/|q|) is computed; a logistic model is fitted to the features times r, and
a two-fold fit calibrates its margin to a probability.  Only the weights, at most FEATURES of them, leave the task.

Their lengths, number and penalty were chosen by cross-validation within the learning fold.

Defined cases: null and empty texts are scored like any text without n-grams, very long ones whole; rows with an unknown label or id are not
learnt from; with no positive or no negative label every score is 0; repeated rows get equal scores; an empty table
gives an empty result; only the text enters a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

NGRAMS = (5, 8)
BUCKET_BITS = 21
BUCKETS = 1 << BUCKET_BITS
POINTS_AT_ONCE = 1_000_000
PER_CLASS = 1500
FEATURES = 10_000
MIN_DOCS = 3
L2 = 1e-3
STEPS = 150
THRESHOLD = 0.7


def marked(text: str | None) -> str:
    """The lower-cased text with white space, and both ends, as one mark."""
    return f"\x00{'\x00'.join((text or '').lower().split())}\x00"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_buckets(points: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Per length the bucket of the n-gram that starts at each place."""
    h, found = np.zeros(len(points), np.uint64), []
    for k in range(1, min(max(lengths), len(points)) + 1):
        h = (h[: len(points) - k + 1] ^ points[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k in lengths:
            found.append(((h + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return found


def text_features(text: str | None, lengths: tuple[int, ...] = NGRAMS) -> np.ndarray:
    """Sorted distinct hashed n-grams of one whole text."""
    found = gram_buckets(code_points(marked(text)), lengths)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def margins(texts: list[str | None], dense: np.ndarray, b: float, lengths: tuple[int, ...] = NGRAMS) -> np.ndarray:
    """Margin of each text: the weights of its distinct n-grams and the intercept."""
    out, at = np.full(len(texts), b), 0
    while at < len(texts):
        some, size = [], 0
        while at + len(some) < len(texts) and (not some or size < POINTS_AT_ONCE):
            some.append(marked(texts[at + len(some)]))
            size += len(some[-1])
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(sizes)
        doc, seen = np.repeat(np.arange(len(some)), sizes), []
        for n, bucket in zip((n for n in sorted(lengths) if n <= size), gram_buckets(code_points("".join(some)), lengths), strict=True):
            hit = np.flatnonzero(dense[bucket])  # few n-grams have a weight
            own = doc[hit]
            inside = hit + n <= ends[own]
            seen.append(own[inside] * BUCKETS + bucket[hit[inside]])
        code = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]))
        out[at : at + len(some)] += np.bincount(code // BUCKETS, dense[code % BUCKETS].astype(float), len(some))
        at += len(some)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series([text_features(t) for t in texts], dtype=object)


class _Rows:
    """Sparse 0/1 rows over a compact feature set."""

    def __init__(self, rows: list[np.ndarray], index: np.ndarray):
        self.n, self.dim = len(rows), len(index)
        cols, row = [], []
        for i, r in enumerate(rows):
            at = np.searchsorted(index, r)
            ok = (at < self.dim) & (index[np.minimum(at, self.dim - 1)] == r)
            cols.append(at[ok])
            row.append(np.full(int(ok.sum()), i))
        self.col, self.row = np.concatenate(cols), np.concatenate(row)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, v[self.row], self.dim)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(dot, back, y: np.ndarray, weight: np.ndarray, dim: int, l2: float) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated gradient descent with a step that shrinks until the loss falls."""
    def loss(w, b):
        m = dot(w) + b
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + l2 / 2 * (w @ w)), m

    w, b, step = np.zeros(dim), 0.0, 1.0
    vw, vb = w, b
    last, _ = loss(w, b)
    for k in range(STEPS):
        start, m = loss(vw, vb)
        g = weight * (_sigmoid(m) - y)
        gw, gb = back(g) + l2 * vw, float(g.sum())
        size = gw @ gw + gb * gb
        if size < 1e-10:
            break
        while step > 1e-9:
            nw, nb = vw - step * gw, vb - step * gb
            new, _ = loss(nw, nb)
            if new <= start - step / 2 * size:
                break
            step /= 2
        if new > last:  # restart the momentum
            vw, vb, last = w, b, np.inf
            continue
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b, last = nw, nb, new
        step *= 1.3
    return w, b


def _fit_margin(rows: list[np.ndarray], y: np.ndarray, l2: float, features_: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature index, weight, intercept) of the ratio-scaled model."""
    every = np.concatenate([*rows, np.zeros(0, np.int32)])
    index, total = np.unique(every, return_counts=True)
    pos = np.zeros(len(index))
    np.add.at(pos, np.searchsorted(index, np.concatenate([r for r, t in zip(rows, y, strict=True) if t])), 1)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    p, q = pos / n1, (total - pos) / n0
    apart = np.abs(p - q) / np.sqrt((total + 1) / (n1 + n0))
    enough = np.flatnonzero(total >= MIN_DOCS)
    best = np.sort(enough[np.argsort(-apart[enough], kind="stable")[:features_]])
    index, pos, neg = index[best], pos[best], (total - pos)[best]
    ratio = np.log((pos + 1) / (pos + 1).sum()) - np.log((neg + 1) / (neg + 1).sum()) if len(best) else pos
    if not len(best):
        return index, ratio, 0.0
    x = _Rows(rows, index)
    w, b = _logistic(lambda v: x.dot(v * ratio), lambda v: x.back(v) * ratio, y, np.where(y, 0.5 / n1, 0.5 / n0), len(index), l2)
    return index, w * ratio, b


def margin(row: np.ndarray, index: np.ndarray, weight: np.ndarray, b: float) -> float:
    if not len(index):
        return b
    at = np.minimum(np.searchsorted(index, row), len(index) - 1)
    return float(weight[at[index[at] == row]].sum()) + b


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, l2: float = L2):
    """(index, weights, intercept, slope, shift): probability = sigmoid(slope * margin + shift).

    ``weight`` restores the classes' shares in the labels, which the bounded sample may have changed.
    """
    held = np.zeros(len(y))
    for fold in (0, 1):
        test = np.arange(len(y)) % 2 == fold
        part = [r for r, t in zip(rows, test, strict=True) if not t]
        model = _fit_margin(part, y[~test], l2)
        held[test] = [margin(r, *model) for r, t in zip(rows, test, strict=True) if t]
    scale = held.std() or 1.0
    slope, shift = _logistic(lambda v: held / scale * v[0], lambda v: np.array([(held / scale) @ v]), y, weight / weight.sum(), 1, 1e-6)
    return *_fit_margin(rows, y, l2), float(slope[0] / scale), float(shift)


def cross_validated_auc(rows: list[np.ndarray], y: np.ndarray, l2: float = L2, features_: int = FEATURES, folds: int = 4) -> float:
    """Area under the ROC curve of margins from models that have not seen the row; for choosing settings."""
    held = np.zeros(len(y))
    for fold in range(folds):
        test = np.arange(len(y)) % folds == fold
        model = _fit_margin([r for r, t in zip(rows, test, strict=True) if not t], y[~test], l2, features_)
        own = np.array([margin(r, *model) for r, t in zip(rows, test, strict=True) if t])
        held[test] = (own - own.mean()) / (own.std() or 1.0)
    order = pd.Series(held).rank().to_numpy()
    pos = y == 1
    return float((order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum()))


def learning_fold(doc_id: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
          per_class: int = PER_CLASS):
    """The model of :func:`fit` from a bounded sample of the learning fold, fitted in one task; None without both classes."""
    usable = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
        .filter("id is not null and y in (0, 1)")
        .filter(learning_fold(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
        .join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    )
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = [F.xxhash64("id", F.lit(5)), F.col("id")]
    sample = usable.filter("y = 1").orderBy(*order).limit(per_class).unionByName(
        usable.filter("y = 0").orderBy(*order).limit(per_class)
    )  # at most 2 * per_class rows: safe to broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = texts.groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text")).select("id", "y", features("text").alias("x"), F.lit(0).alias("part"))
    share = {c: n / min(n, per_class) for c, n in counts.items()}

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        y = pdf["y"].to_numpy(float)
        weight = np.where(y, share[1], share[0])
        index, w, b, slope, shift = fit([np.asarray(r, np.int32) for r in pdf["x"]], y, weight)
        return pd.DataFrame({"index": [index.astype("<i4").tobytes()], "w": [w.astype("<f4").tobytes()], "b": [b], "slope": [slope], "shift": [shift]})

    got = rows.groupBy("part").applyInPandas(task, "index binary, w binary, b double, slope double, shift double").collect()[0]
    return np.frombuffer(got["index"], "<i4"), np.frombuffer(got["w"], "<f4"), got["b"], got["slope"], got["shift"]


def scorer(df: DataFrame, model) -> "callable":
    """A column function text -> probability for the session of ``df``."""
    if model is None:
        return lambda text: F.lit(0.0)
    index, w, b, slope, shift = model
    dense = np.zeros(BUCKETS, np.float32)
    dense[index] = w
    shared = df.sparkSession.sparkContext.broadcast((dense, b, slope, shift))  # BUCKETS floats, whatever the input

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        dense, b, slope, shift = shared.value
        return pd.Series(_sigmoid(slope * margins(texts.tolist(), dense, b) + shift), dtype="float64")

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    out: str = "score") -> DataFrame:
    """``docs`` with a score column named ``out`` (replacing one of that name)."""
    return docs.withColumn(out, scorer(docs, train(docs, labels, id_col, text_col))(F.col(text_col)))
