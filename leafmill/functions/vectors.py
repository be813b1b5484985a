"""Column functions on dense vectors, and the hash embedding."""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as fv

ROWS_COUNTED = 1024  # texts whose buckets are counted at a time


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    def scaled(size):
        return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))

    return F.transform(F.array(norm(a)), scaled)[0]


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def hash_embedding(text: Column, dim: int = fv.VECTOR_DIM) -> Column:
    """array<float>: each token adds 1 to eight buckets taken from its SHA-256.

    Spark has no function that counts into a dense array, and grouping by
    bucket would shuffle up to eight rows per token, so a slice of an Arrow batch at a
    time is counted with numpy. A token's buckets are looked up once per slice.
    The counts are exact; `l2_normalise` gives the unit vector.
    """
    pairs = fv.DIGEST_PAIRS

    def encode(texts: "pa.Array") -> "pa.Array":
        import hashlib

        import numpy as np

        counts = []
        for at in range(0, len(texts), ROWS_COUNTED):
            words = [(text or "").lower().split() or ["__empty__"] for text in texts.slice(at, ROWS_COUNTED).to_pylist()]
            coded = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
            digests = b"".join([hashlib.sha256(t.encode("utf-8")).digest()[:2 * pairs] for t in coded.dictionary.to_pylist()])
            buckets = np.frombuffer(digests, dtype=">u2").astype(np.int32).reshape(-1, pairs) % dim
            row = np.repeat(np.arange(len(words), dtype=np.int32) * dim, [len(w) for w in words])
            cells = buckets[coded.indices.to_numpy()] + row[:, None]
            counts.append(np.bincount(cells.ravel(), minlength=len(words) * dim).astype(np.float32))
        values = np.concatenate(counts) if counts else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(values))

    return F.arrow_udf(encode, "array<float>")(text)
