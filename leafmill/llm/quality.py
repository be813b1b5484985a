"""Quality scores by Bradley-Terry ranking: weights that put good documents above poor ones, pair by pair.

Strength of a document is w.f(text); P(good beats poor) = 1 / (1 + exp(-(w.f_good - w.f_poor))).
The threshold is a quantile of the training documents' strengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import hash_words, slices

#: Labelled rows of each class that the fit may use; bounds what the driver gathers.
MAX_ROWS_PER_CLASS = 8000
#: Score at the cut.
CUT = 0.3

_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _MARK, _HIGH, _LINE = range(8)
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_CLASS[48:58] = _DIGIT
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_CLASS[128:] = _HIGH


def features(texts: list[bytes]) -> np.ndarray:
    """Measures of form, one row per text; an empty text has zeros.

    Shares of byte classes; share of words that repeat the word before, that are new in
    the text, that end in a mark, that are all capitals, that are a mark alone; mean
    word length; share of word pairs that are new; the worst such shares over windows
    of 64 words; length.
    """
    n = len(texts)
    owner, starts, ends, hashes, data = hash_words(texts, keep_case=True)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    kinds = _CLASS[data] if len(data) else np.zeros(0, np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    sums = np.zeros((n, 8))
    for k in range(8):
        running = np.concatenate(([0], np.cumsum(kinds == k)))
        sums[:, k] = running[np.minimum(first + sizes, len(kinds))] - running[np.minimum(first, len(kinds))]
    shares = sums / np.maximum(sizes, 1)[:, None]
    words = np.bincount(owner, minlength=n).astype(float)
    per_word = np.maximum(words, 1)
    same_text = np.concatenate(([False], owner[1:] == owner[:-1])) if len(owner) else np.zeros(0, bool)
    repeats = same_text & np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(owner) else np.zeros(0, bool)

    def new(keys: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        out = np.ones(len(k), bool)
        out[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        marked = np.zeros(len(k), bool)
        marked[order] = out  # lexsort is stable: the earliest of equals
        return marked

    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    ends_in_mark = last == _MARK
    alone = ends_in_mark & (ends - starts == 1)
    upper = np.concatenate(([0], np.cumsum(kinds == _UPPER)))
    lower = np.concatenate(([0], np.cumsum(kinds == _LOWER)))
    capitals = (upper[ends] - upper[starts] > 0) & (lower[ends] - lower[starts] == 0) & (ends - starts > 1)
    pairs = np.zeros(len(hashes), np.uint64)
    if len(hashes):
        pairs[1:] = hashes[1:] * np.uint64(31) + hashes[:-1]
        pairs[0] = hashes[0]
    flags = [repeats, ~new(hashes), ~new(pairs), ends_in_mark, alone, capitals]
    rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner] if len(owner) else np.zeros(0, np.int64)
    widest = int(rank.max()) // 64 + 1 if len(rank) else 1
    window = owner * widest + rank // 64
    used, inverse, held = np.unique(window, return_inverse=True, return_counts=True) if len(window) else (window, window, window)
    columns = []
    for flag in flags:
        columns.append(np.bincount(owner, weights=flag, minlength=n) / per_word)
        worst = np.zeros(n)
        if len(used):
            share = np.bincount(inverse, weights=flag) / np.maximum(held, 16)
            np.maximum.at(worst, used // widest, share)
        columns.append(worst)
    length = np.bincount(owner, weights=ends - starts, minlength=n) / per_word
    columns += [length / 10, np.log1p(words) / 10, sums[:, _LINE] / per_word]
    basic = np.column_stack([shares, *columns])
    return np.concatenate([basic, np.sqrt(basic), basic * basic], axis=1)


@dataclass(frozen=True)
class QualityModel:
    """What the tasks need: a few dozen numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, f: np.ndarray) -> np.ndarray:
        strength = ((f - self.mean) / self.scale) @ self.weights
        z = np.clip(self.slope * (strength - self.cut) + np.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-z))


def fit_pairs(good: np.ndarray, poor: np.ndarray, rounds: int = 600, pairs: int = 4096, decay: float = 1e-3, seed: int = 7) -> QualityModel:
    """Bradley-Terry weights by Adam on the logistic loss of feature differences, then the quantile cut.

    The cut is the quantile of all strengths that best separates the classes (mean of
    both recalls); the slope makes scores a logistic fit around it.
    """
    every = np.concatenate([good, poor])
    mean, scale = every.mean(0), every.std(0) + 1e-6
    a, b = (good - mean) / scale, (poor - mean) / scale
    rng, w = np.random.default_rng(seed), np.zeros(every.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        d = a[rng.integers(len(a), size=pairs)] - b[rng.integers(len(b), size=pairs)]
        g = -(d / (1 + np.exp(np.clip(d @ w, -50, 50)))[:, None]).mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    sa, sb = a @ w, b @ w
    cuts = np.quantile(np.concatenate([sa, sb]), np.linspace(0.002, 0.998, 499))
    quality = np.array([(sa >= c).mean() + (sb < c).mean() for c in cuts])
    best = np.flatnonzero(quality >= quality.max() - 1e-9)
    cut = float(cuts[best].mean())
    z, y, slope = np.concatenate([sa, sb]) - cut, np.concatenate([np.ones(len(sa)), np.zeros(len(sb))]), 1.0
    for _ in range(200):
        p = 1 / (1 + np.exp(np.clip(-slope * z - np.log(CUT / (1 - CUT)), -50, 50)))
        slope = float(np.clip(slope + 0.5 * ((y - p) * z).mean() / max(1e-6, (p * (1 - p) * z * z).mean() + 1e-3), 0.05, 5))
    return QualityModel(mean, scale, w, cut, slope)


def labelled_sample(documents: DataFrame, labels: DataFrame, wanted, per_class: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of at most `per_class` labelled rows of each class, in the order of a hash of the id.

    Only ids of that bounded number are broadcast; documents are filtered where they
    lie. Rows without an id, a label or a document drop out; a repeated label row counts once.
    """
    spark = documents.sparkSession
    rows = labels.filter(wanted & F.col("label").isNotNull() & F.col(ident).isNotNull()).groupBy(ident).agg(F.min("label").alias("label"))
    parts = [rows.filter(F.col("label") == k).orderBy(F.xxhash64(ident), ident).limit(per_class) for k in (0, 1)]
    found = [(r[ident], int(r["label"])) for part in parts for r in part.select(ident, "label").collect()]
    schema = f"{ident} {dict(documents.dtypes)[ident]}, label int"
    return documents.select(ident, text).join(F.broadcast(spark.createDataFrame(found, schema)), ident)


def fit_quality(documents: DataFrame, labels: DataFrame, wanted, ident: str = "doc_id", text: str = "text",
                per_class: int = MAX_ROWS_PER_CLASS) -> QualityModel | None:
    """A model from `labels` (id, label 0/1) where `wanted` holds; None if a class has no row.

    Features are made in the tasks; the driver gathers at most 2 x `per_class` rows of numbers.
    """
    def run(batches):
        for rows, texts in slices(batches, text):
            f = features(texts)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("label")), pa.array(list(f), pa.list_(pa.float64()))], ["label", "f"])

    sample = labelled_sample(documents, labels, wanted, per_class, ident, text)
    rows = sample.mapInArrow(run, "label int, f array<double>").toPandas()
    if rows["label"].nunique() < 2:
        return None
    f = np.vstack(rows["f"].to_numpy())
    order = np.lexsort(f.T)  # the fit does not depend on the order of arrival
    f, label = f[order], rows["label"].to_numpy()[order]
    return fit_pairs(f[label == 1], f[label == 0])


def score_quality(documents: DataFrame, model: QualityModel | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) of every row: map-only, each text whole.

    Null and empty texts are scored as texts of no words. Without a model (no
    labelled row of a class) every score is 0.5. Other columns are not read.
    """
    kind = dict(documents.dtypes)[ident]

    def run(batches):
        for rows, texts in slices(batches, text):
            score = model.scores(features(texts)) if model is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(ident)), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                                             [ident, "score", "predicted"])

    return documents.select(ident, text).mapInArrow(run, f"{ident} {kind}, score double, predicted int")


def keep_good(documents: DataFrame, model: QualityModel | None, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model scores at the cut or above: map-only.

    Without a model every row stays.
    """
    if model is None:
        return documents

    def run(batches):
        for rows, texts in slices(batches, text):
            yield rows.filter(pa.array(model.scores(features(texts)) >= CUT))

    return documents.mapInArrow(run, documents.schema)
