"""Periodic stretches of words: every maximal run, by minimizers at doubling scales.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(`least`, 2 * q) that no neighbour extends at period q. Periods below `short` are found
by comparing the words with themselves at each lag. Longer ones go by scale, periods from
Q up to 2 * Q: each word run of k = Q / 2 words has a hash, and of every k neighbouring
hashes the least, leftmost, is a minimizer. Two windows at the distance of the period hold
the same words, so their minimizers are equal and lie a period apart: pairs of equal ones
at a distance of Q to 2 * Q are seeds, extended by comparing words.

Word runs that are periodic themselves, at k / 2 or less, would be minimizers everywhere
and pair with all their like. They are left out, as the runs they lie in are known from
smaller scales. A window without any other word run lies in one known run, and then the
starts of two such runs are a period apart, or their ends are, or the runs touch; each
gives seeds as well, so no run is lost. A minimizer has at most eight equal ones within
2 * Q, so the work is about the number of words at each scale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import mix, slices

#: Least length of a run; periods from here on go by minimizers.
LEAST, SHORT = 12, 32
_U = np.uint64
_LEFT_OUT = _U(0xFFFFFFFFFFFFFFFF)
#: Seeds extended together, and words compared for them at once.
_SEEDS, _BLOCK = 4096, 1 << 18
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _stretches(same: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of stretches of at least `need` true values."""
    at = np.flatnonzero(same)
    if len(at) < need or not (at[need - 1:] - at[:len(at) - need + 1] == need - 1).any():
        return at[:0], at[:0]
    cut = np.flatnonzero(np.diff(at) != 1)
    first, end = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1
    long = end - first >= need
    return first[long], end[long]


def _agree(words: np.ndarray, x: np.ndarray, q: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from x on, in direction `step`, equal the ones q further; at most `most`."""
    out, last = np.zeros(len(x), np.int64), len(words) - 1
    for begin in range(0, len(x), _SEEDS):
        live = np.arange(begin, min(len(x), begin + _SEEDS))
        live = live[most[live] > 0]
        while len(live):
            left = most[live] - out[live]
            wide = int(min(max(16, _BLOCK // len(live)), left.max()))
            at = (x[live] + step * out[live])[:, None] + step * np.arange(wide)
            differ = words[np.clip(at, 0, last)] != words[np.clip(at + q[live][:, None], 0, last)]
            good = np.where(differ.any(1), differ.argmax(1), wide)
            out[live] += np.minimum(good, left)
            live = live[(good == wide) & (left > wide)]
    return out


def _pairs(places: np.ndarray, keys: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of places with equal keys from `low` to less than 2 * `low` apart."""
    order = np.lexsort((places, keys))
    places, keys, x, q, t = places[order], keys[order], [], [], 1
    while t < len(places):
        near = np.flatnonzero((keys[t:] == keys[:-t]) & (places[t:] - places[:-t] < 2 * low))
        if not len(near):
            break
        far = near[places[near + t] - places[near] >= low]
        x.append(places[far])
        q.append(places[far + t] - places[far])
        t += 1
    return (np.concatenate(x), np.concatenate(q)) if x else (places[:0], places[:0])


def _touching(words: np.ndarray, runs: np.ndarray, low: int) -> tuple[list[int], list[int]]:
    """Seeds of runs whose period is cut from two neighbouring runs of one smaller period."""
    xs, qs = [], []
    runs = runs[runs[:, 1] - runs[:, 0] >= low]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    for i in np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= runs[:-1, 1])).tolist():
        (s, e, p), (s2, e2, _) = runs[i].tolist(), runs[i + 1].tolist()
        begin = words[s2:s2 + p]
        for r in range(p):
            if (words[e - p - r:e - r] == begin).all():
                shift = s2 - (e - p - r)
                for q in range(low + (shift - low) % p, 2 * low, p):
                    x = max(s, s2 - q)
                    if min(e, e2 - q) - x >= q:
                        xs.append(x)
                        qs.append(q)
                break
    return xs, qs


def _extended(words: np.ndarray, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the stretches around seeds that are two periods or longer.

    A seed is followed no further than the next one of its period: those it reaches are one stretch.
    """
    order = np.lexsort((x, q))
    x, q = x[order], q[order]
    fresh = np.concatenate(([True], (x[1:] != x[:-1]) | (q[1:] != q[:-1])))
    x, q = x[fresh], q[fresh]
    gap = np.full(len(x), len(words), np.int64)
    again = q[1:] == q[:-1]
    gap[:-1][again] = (x[1:] - x[:-1])[again]
    ahead = _agree(words, x, q, gap, 1)
    joined = np.concatenate(([False], again & (ahead[:-1] == gap[:-1])))
    first = np.flatnonzero(~joined)
    last = np.concatenate((first[1:], [len(x)])) - 1
    start = x[first] - _agree(words, x[first] - 1, q[first], x[first], -1)
    end, period = x[last] + ahead[last] + q[first], q[first]
    return np.stack([start, end, period], 1)[end - start >= 2 * period]


def _distinct(runs: list[np.ndarray]) -> np.ndarray:
    """One row per stretch, with the smallest period found for it."""
    rows = np.concatenate(runs)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
    return rows[np.concatenate(([True], ~same))] if len(rows) else rows


def find_runs(words: np.ndarray, begins: np.ndarray, lengths: np.ndarray, least: int = LEAST, short: int = SHORT) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and end.

    `words` are the word numbers of texts in ascending order of length, with a number of
    its own before, between and after the texts; `begins` and `lengths` say where they lie.
    `short` is a power of two of at least twice `least`, so that runs which hide
    minimizers are known.
    """
    if short < 4 or short & (short - 1) or short < 2 * least:
        raise ValueError("short must be a power of two of at least twice least")
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, short):
        text = int(np.searchsorted(lengths, max(least, 2 * q)))
        if text == len(lengths):
            break
        base = int(begins[text]) - 1
        first, end = _stretches(words[base:-q] == words[base + q:], max(least, 2 * q) - q)
        found.append(np.stack([first + base, end + base + q, np.full(len(first), q)], 1))
    known = _distinct(found)
    base, k, hashes, low = 0, 1, None, short
    while True:
        text = int(np.searchsorted(lengths, 2 * low))
        if text == len(lengths):
            return known
        if hashes is None:
            base = int(begins[text]) - 1
            hashes = mix(words[base:].astype(np.uint64) + _U(1))
        else:
            hashes, base = hashes[int(begins[text]) - 1 - base:], int(begins[text]) - 1
        while k < low // 2:
            hashes = mix(hashes[:len(hashes) - k] * _U(0x9E3779B97F4A7C15) + hashes[k:])
            k *= 2
        inner = known[(2 * known[:, 2] <= k) & (known[:, 1] - known[:, 0] >= k) & (known[:, 0] >= base)]
        bits = _U(len(hashes).bit_length())
        least_of = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        hidden = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(hidden, inner[:, 0] - base, 1)
        np.add.at(hidden, inner[:, 1] - base - k + 1, -1)
        least_of[np.cumsum(hidden)[:-1] > 0] = _LEFT_OUT
        w = 1
        while w < k and len(least_of) > w:
            least_of = np.minimum(least_of[:-w], least_of[w:])
            w *= 2
        least_of = least_of[np.concatenate(([True], least_of[1:] != least_of[:-1]))]
        places = (least_of[least_of != _LEFT_OUT] & ((_U(1) << bits) - _U(1))).astype(np.int64)
        seeds = [_pairs(places, hashes[places], low)]
        for places in (inner[:, 0] - base, inner[:, 1] - base - k):
            seeds.append(_pairs(places, hashes[places], low))
        x, q = _touching(words, inner, low)
        x = np.concatenate([s[0] + base for s in seeds] + [np.array(x, np.int64)])
        q = np.concatenate([s[1] for s in seeds] + [np.array(q, np.int64)])
        if len(x):
            known = _distinct([known, _extended(words, x, q)])
        low *= 2


def runs_of(texts: list[list[bytes]], least: int = LEAST, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """For word lists: rows (text, start, length, period) by text, start and period, and which of all words stay."""
    lengths = np.array([len(t) for t in texts], np.int64)
    stay = np.ones(int(lengths.sum()), bool)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] >= least]
    if not len(order):
        return np.zeros((0, 4), np.int64), stay
    numbers = pa.array([w for i in order.tolist() for w in texts[i]], pa.binary()).dictionary_encode().indices.to_numpy()
    size = lengths[order]
    begins = np.cumsum(size + 1) - size
    words = np.full(len(numbers) + len(order) + 1, -1, np.int64)
    owner = np.repeat(np.arange(len(order)), size)
    words[np.arange(len(numbers)) + owner + 1] = numbers
    apart = words < 0
    words[apart] = len(numbers) + np.arange(int(apart.sum()))
    runs = find_runs(words, begins, size, least, short)
    at = np.searchsorted(begins, runs[:, 0], side="right") - 1
    rows = np.stack([order[at], runs[:, 0] - begins[at], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    first = np.cumsum(lengths) - lengths
    covered = np.zeros(len(stay) + 1, np.int64)
    np.add.at(covered, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.add.at(covered, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
    return rows, np.cumsum(covered)[:-1] == 0


def periodic_runs(documents: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST, short: int = SHORT) -> DataFrame:
    """(ident, runs, collapsed) per row of `documents`.

    `runs` lists (start, length, period) in words, by start and period; `collapsed` holds
    the words, parted by one space, less those that a run repeats: all of a run after its
    first period. Words are runs of bytes other than 09-0D and 20. Map-only; a slice of
    texts at a time, so memory follows the longest text. A null or empty text has no runs
    and an empty collapsed text; repeated rows and null ids stay as they are; other columns
    are not read.
    """
    kind = documents.schema[ident].dataType.simpleString()

    def run(batches):
        for rows, raw in slices(batches, "_text"):
            texts = [t.split() for t in raw]
            runs, stay = runs_of(texts, least, short)
            counts = np.bincount(runs[:, 0], minlength=len(texts))
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(runs[:, c].copy()) for c in (1, 2, 3)], fields=list(_TYPE.value_type))
            first, collapsed = 0, []
            for t, n in zip(texts, counts.tolist()):
                collapsed.append(b" ".join([w for w, s in zip(t, stay[first:first + len(t)].tolist()) if s] if n else t))
                first += len(t)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), items).cast(_TYPE),
                                              pa.array(collapsed, pa.binary()).view(pa.string())], ["_id", "runs", "collapsed"])

    named = documents.select(F.col(ident).alias("_id"), F.col(text).alias("_text"))
    out = named.mapInArrow(run, f"_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.withColumnRenamed("_id", ident)


def repeat_tails(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """`documents` with (ident, text), where about a tenth of the texts repeat a stretch up to their end.

    With h the crc32 of the id and g = floor(h / 10): if 10 divides h, each word from number
    a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Row
    expressions only. A null id or text leaves the row as it is.
    """
    h = F.crc32(F.col(ident).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
            w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")).otherwise("")

    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return documents.select(ident, F.when(h % 10 == 0, F.get(F.transform(F.array(words), looped), F.lit(0))).otherwise(F.col(text)).alias(text))


def run_columns(runs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The counts and digests of `periodic_runs`; the greatest run, of equal ones the first, then the shortest period."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return runs.withColumn("_best", best).select(
        ident, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.less")).alias("length"),
        F.col("_best.period").alias("period"), F.floor(-1000 * F.col("_best.less") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
