"""Shared parts: tables, folds, and words of many texts hashed at once in numpy."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, and rows, that are handled together; bounds a task's working memory.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 50_000
#: Bytes of one text that are hashed together.
PIECE_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but 09-0D and 20.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[9:14] = NOT_SPACE[32] = False
#: Word bytes after lower-casing: digits, a-z and everything from 80 on.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TABLE = None
_POWERS = np.ones(1, dtype=np.uint64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    while name in df.columns:
        name = f"_{name}"
    return name


def fold(ident: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id falls in no fold that is left out."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds, F.lit(-1))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_table() -> np.ndarray:
    """A fixed random 64-bit number for each byte value."""
    global _TABLE
    if _TABLE is None:
        _TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    return _TABLE


def powers(n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS[:n]


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


#: What this worker keeps from one task to the next, by operator.
KEPT: dict[str, dict] = {}


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES, rows: int = SLICE_ROWS, keep: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows with at most `size` bytes of text (one row, if it has more) and at most `rows` rows.

    Only the texts of one slice are Python objects at a time. Workers live on and serve
    other stages, so a task first lets go of what other operators than `keep` have left in
    its worker, and of what the allocators hold back.
    """
    for name in [n for n in KEPT if n != keep]:
        del KEPT[name]
    _give_back()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < len(ends):
            held = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, held + size + 1, side="right"))), start + rows)
            yield batch.slice(start, stop - start), texts_of(column.slice(start, stop - start))
            start = stop
    _give_back()


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _hash_piece(low: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    terms = byte_table()[low[inside]] * powers(int(lens.max()))[place]
    return starts, ends, mix(np.add.reduceat(terms, first) + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def hash_words(texts: list[bytes], word: np.ndarray = NOT_SPACE, keep_case: bool = False):
    """Words of all texts in order: (text number, byte offsets of start and end in the joined buffer, hash), and the buffer.

    A word is a run of bytes that `word` marks, after A-Z are lower-cased (unless
    `keep_case`). Texts are joined by a line feed, so words never cross texts; the
    work goes in pieces cut at a word's edge, so memory is bounded by the words' arrays.
    """
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    low = data if keep_case else LOWER[data]
    inside = word[low]
    starts, ends, hashes, at = [], [], [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE_BYTES)
        if stop < len(data) and inside[stop - 1] and inside[stop]:
            back = int(np.argmin(inside[at:stop][::-1]))
            if not inside[stop - 1 - back]:
                stop -= back
            else:  # one word longer than a piece
                ahead = int(np.argmin(inside[stop:]))
                stop = stop + ahead if not inside[stop + ahead] else len(data)
        s, e, h = _hash_piece(low[at:stop], inside[at:stop])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = stop
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, starts, side="right")
    return owner, starts, ends, hashes, data


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive hashes, order-sensitive."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * _BASE + hashes[j:len(hashes) - n + 1 + j]
    return mix(out)


#: Bits of a table of ids that tasks get before a join on them: 4 MB, however many ids there are.
ID_BITS = 1 << 25


def rows_of(documents: DataFrame, ids: DataFrame, ident: str) -> DataFrame:
    """`documents` less most rows whose id is not in `ids`, before anything is shuffled; a join must follow.

    One bit per hash of an id, in a table of fixed size; the more ids, the more other rows pass.
    """
    place = F.pmod(F.xxhash64(ident), F.lit(ID_BITS))
    size = ID_BITS // 64

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(size, bool)
        flags[table["place"].to_numpy() % size] = True
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    places = ids.select(place.alias("place")).distinct().withColumn("part", F.floor(F.col("place") / size).cast("int"))
    parts = {r["part"]: r["bits"] for r in places.groupBy("part").applyInArrow(pack, "part int, bits binary").collect()}
    bits = np.frombuffer(b"".join(bytes(parts.get(k, bytes(size // 8))) for k in range(64)), np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def keep(batches):
        held = shared.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))).drop_columns(["_place"])

    return documents.withColumn("_place", place).mapInArrow(keep, documents.schema)
