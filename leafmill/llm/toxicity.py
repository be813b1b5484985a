"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other documents are unlabelled,
whatever their labels say. With class prior p the risk of a linear scorer g is

    p * mean(loss(g(positive), 1)) + max(0, mean(loss(g(unlabelled), 0)) - p * mean(loss(g(positive), 0)))
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ALNUM, LOWER, hash_words, mix, slices
from leafmill.llm.quality import labelled_sample

#: Buckets of the hashed vocabulary, as a power of two.
BITS = 20
#: Texts that the fit may use of either kind; bounds what the driver gathers.
MAX_POSITIVE, MAX_UNLABELLED = 2500, 6000
#: Standard errors by which a bucket's share must differ to get a weight.
SURE = 4.5
CUT = 0.7
#: Occurrences of a bucket in one text that count.
MOST = 3


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each word and of each word's first 5, 6, 7 and 8 bytes.

    Words are runs of letters and digits, lower-cased; the beginnings catch inflected forms.
    """
    owner, starts, ends, hashes, data = hash_words(texts, ALNUM)
    owners, keys = [owner], [hashes]
    padded = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    packed = np.zeros(len(starts), np.uint64)
    for j in range(8):
        packed |= padded[starts + j].astype(np.uint64) << np.uint64(8 * j)
        if j >= 4:
            longer = ends - starts > j + 1
            owners.append(owner[longer])
            keys.append(mix(packed[longer] + np.uint64(j)))
    return np.concatenate(owners), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the buckets that have one (sorted), and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        owner, bucket = buckets(texts)
        known = np.zeros(1 << BITS, bool)
        known[self.keys] = True
        hit = known[bucket]
        if hit.any():
            pairs, times = np.unique(owner[hit] * (1 << BITS) + bucket[hit], return_counts=True)
            np.add.at(z, pairs >> BITS, np.minimum(times, MOST) * self.weights[np.searchsorted(self.keys, pairs & ((1 << BITS) - 1))])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, decay: float = 2e-4) -> ToxicityModel:
    """Weights by Adam on the non-negative risk with logistic loss.

    A text is given as the array of bucket * MOST + occurrences - 1 of its buckets.

    Where the bracket falls below zero the step goes up its gradient instead of down,
    which undoes the overfit. Only buckets get a weight that at least three positives
    hold and whose share among positives differs from that among unlabelled texts by
    more than SURE standard errors. The intercept is then set so that a score of 0.7 is
    the cut with the best F1, precision being estimated by the prior.
    """
    def counts(rows):
        return np.bincount(np.concatenate(rows) // MOST, minlength=1 << BITS) if rows else np.zeros(1 << BITS)

    a, u = counts(positive), counts(unlabelled)
    share_a, share_u = a / max(1, len(positive)), u / max(1, len(unlabelled))
    pooled = (a + u + 1) / (len(positive) + len(unlabelled) + 2)
    error = np.sqrt(pooled * (1 - pooled).clip(0) * (1 / max(1, len(positive)) + 1 / max(1, len(unlabelled))))
    keys = np.flatnonzero((a >= 3) & (np.abs(share_a - share_u) > SURE * (error + 1e-12)))
    place = np.full(1 << BITS, -1)
    place[keys] = np.arange(len(keys))

    def sparse(rows):
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        text, every = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        column = place[every // MOST]
        return text[column >= 0], column[column >= 0], (every % MOST + 1.0)[column >= 0]

    (pt, pc, px), (ut, uc, ux) = sparse(positive), sparse(unlabelled)
    n_p, n_u = len(positive), max(1, len(unlabelled))
    w, b = np.zeros(len(keys)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    for t in range(1, rounds + 1):
        zp = b + np.bincount(pt, weights=px * w[pc], minlength=n_p)
        zu = b + np.bincount(ut, weights=ux * w[uc], minlength=n_u)
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / n_p, np.zeros(n_u)
        if negative >= 0:
            gp, gu = gp - prior * sp / n_p, su / n_u
        else:
            gp, gu = prior * sp / n_p, -su / n_u
        g = np.bincount(pc, weights=px * gp[pt], minlength=len(keys)) + np.bincount(uc, weights=ux * gu[ut], minlength=len(keys)) + decay * w
        gb = gp.sum() + gu.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    zp = b + np.bincount(pt, weights=px * w[pc], minlength=n_p)
    zu = np.sort(b + np.bincount(ut, weights=ux * w[uc], minlength=n_u))
    # the estimated error of a cut c: missed positives and, by the prior, unlabelled texts above it that are not toxic
    cuts = np.unique(np.quantile(np.concatenate([zp, zu]), np.linspace(0, 1, 2001)))
    recall = 1 - np.searchsorted(np.sort(zp), cuts) / n_p
    above = 1 - np.searchsorted(zu, cuts) / n_u
    precision = np.minimum(1, prior * recall / np.maximum(above, 1e-9))
    f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-9)
    best = int(np.argmax(f1))
    low = cuts[best - 1] if best else cuts[best] - 1
    middle = (cuts[best] + low) / 2
    return ToxicityModel(keys, w, b - middle + float(np.log(CUT / (1 - CUT))))


def fit_toxicity(documents: DataFrame, labels: DataFrame, wanted, ident: str = "doc_id", text: str = "text",
                 max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicityModel | None:
    """A model from positives (label 1 where `wanted` holds) and unlabelled texts; None without positives.

    The prior follows from the share of label 1 among the label rows where `wanted`
    holds, less the positives taken out. The unlabelled texts are all other documents, of which the fit takes those first in the
    order of a hash of the id, at most `max_unlabelled`.
    """
    spark = documents.sparkSession
    named = labels.filter(wanted & F.col("label").isNotNull() & F.col(ident).isNotNull())
    total, toxic = named.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total or not toxic:
        return None
    rows = named.groupBy(ident).agg(F.max("label").alias("label")).filter("label = 1")
    positive = [(r[ident], 1) for r in rows.orderBy(F.xxhash64(ident), ident).limit(max_positive).select(ident).collect()]
    known, every = rows.count(), documents.filter(F.col(ident).isNotNull()).count()
    prior = (toxic / total * every - known) / max(1, every - known)  # of what stays unlabelled
    prior = min(0.5, max(1e-3, prior))
    others = documents.select(ident).filter(F.col(ident).isNotNull()).join(rows.select(ident), ident, "left_anti")
    free = [(r[ident], 0) for r in others.distinct().orderBy(F.xxhash64(ident), ident).limit(max_unlabelled).collect()]
    picked = spark.createDataFrame(positive + free, f"{ident} {dict(documents.dtypes)[ident]}, label int")
    sample = documents.select(ident, text).join(F.broadcast(picked), ident)

    def run(batches):
        for batch, texts in slices(batches, text):
            owner, bucket = buckets(texts)
            pairs, times = np.unique(owner * (1 << BITS) + bucket, return_counts=True)
            cut = np.searchsorted(pairs >> BITS, np.arange(1, len(texts)))
            packed = (pairs & ((1 << BITS) - 1)) * MOST + np.minimum(times, MOST) - 1
            blobs = [x.astype(np.int32).tobytes() for x in np.split(packed, cut)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(ident)), batch.column(batch.schema.get_field_index("label")), pa.array(blobs, pa.binary())],
                                             [ident, "label", "held"])

    rows = sample.mapInArrow(run, f"{ident} {dict(documents.dtypes)[ident]}, label int, held binary").toPandas().sort_values([ident, "held"])
    held = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["held"]]
    label = rows["label"].to_numpy()
    if not (label == 1).any():
        return None
    return fit_nnpu([h for h, k in zip(held, label) if k == 1], [h for h, k in zip(held, label) if k == 0], prior)


def score_toxicity(documents: DataFrame, model: ToxicityModel | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) of every row: map-only, each text whole.

    Null and empty texts get the intercept's score. Without a model (no confirmed
    toxic text) every score is 0. Other columns are not read.
    """
    kind = dict(documents.dtypes)[ident]

    def run(batches):
        for rows, texts in slices(batches, text):
            score = model.scores(texts) if model is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(ident)), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                                             [ident, "score", "predicted"])

    return documents.select(ident, text).mapInArrow(run, f"{ident} {kind}, score double, predicted int")
