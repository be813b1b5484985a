"""Repeated byte strings removed by suffix arrays.

Every window of `size` bytes has one anchor: the k-gram with the least hash in it, the
rightmost if several. Consecutive windows with the same anchor are a block, and equal
windows have equal anchors. So windows meet under their anchor's hash:

1. Blocks of one anchor that are byte for byte the same everywhere are counted, not compared.
2. An anchor that stands alone has no repeated window.
3. The other blocks, one of each kind, go by anchor to shards. A shard gets a suffix
   array (Larsson-Sadakane) and common prefixes (Kasai); windows whose neighbour in the
   array shares `size` bytes are repeated. All windows of a block hold its anchor, so the
   repeated ones cover one range of bytes, from the first of them to the last.
4. An anchor with more text than a shard holds is dealt over several shards, whose sorted
   window keys are then merged by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import byte_table, mix, slices
from leafmill.llm.suffixes import common_prefixes, suffix_array
from leafmill.session import cut_lineage

SIZE, GRAM = 400, 64
#: Bytes of text that one suffix array holds; window starts of one text that are handled together.
SHARD_BYTES, PIECE = 500_000, 1_500_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bits of a gram's hash that make room for its place; pieces are taken together as far as their places fit.
_PLACE_BITS = 23
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Spans:
    """Hashes of any byte range of a buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte_table()[data] * up[:len(data)], dtype=np.uint64)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the `gram` (a power of two) bytes from each place on, by doubling."""
    h, step = byte_table()[data], 1
    while step < gram:
        h = mix(h[:-step] * _U(_BASE) + h[step:] + _U(step))
        step *= 2
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for each i, in two sweeps over blocks of the width."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([x, pad]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def blocks(pieces: list[bytes], size: int = SIZE, gram: int = GRAM, place_bits: int = _PLACE_BITS):
    """Blocks of all pieces: (piece, first window start in it, windows, distance to the anchor, anchor hash, hash of the bytes).

    Windows do not cross pieces. Pieces go together in groups of at most 2**place_bits
    bytes; a larger piece is cut, with size - 1 bytes in both parts.
    """
    room = 1 << place_bits
    if room < size:
        raise ValueError("a window does not fit into 2**place_bits bytes")
    step, parts, groups, held = room - size + 1, [], [], room + 1
    for i, p in enumerate(pieces):
        for at in range(0, max(1, len(p) - size + 1), step):
            part = p[at:at + room] if len(p) > room else p
            if held + len(part) > room:
                groups.append([])
                held = 0
            groups[-1].append(len(parts))
            parts.append((i, at, part))
            held += len(part)
    found = []
    for group in groups:
        part, start, *rest = _blocks_of([parts[k][2] for k in group], size, gram, place_bits)
        which, base = (np.array([parts[k][j] for k in group], np.int64) for j in (0, 1))
        found.append((which[part], base[part] + start, *rest))
    return tuple(map(np.concatenate, zip(*found))) if found else _blocks_of([], size, gram, place_bits)


def _blocks_of(pieces: list[bytes], size: int, gram: int, place_bits: int):
    """Blocks of pieces that hold at most 2**place_bits bytes together."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    lens = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lens)
    grams = _gram_hashes(data, gram)
    low = _U((1 << place_bits) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least((grams & ~low) | (low - place), size - gram + 1)
    anchor = (low - (least & low)).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), lens)[:len(anchor)]
    valid = np.arange(len(anchor)) + size <= ends[owner]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(valid & change)
    block = np.cumsum(valid & change) - 1
    count = np.bincount(block[valid], minlength=len(starts)).astype(np.int64)
    spans = Spans(data)
    return (owner[starts], starts - (ends - lens)[owner[starts]], count, anchor[starts] - starts,
            mix(grams[anchor[starts]]), spans.hash(starts, starts + count + size - 1))


def repeated_windows(texts: list[bytes], weights: np.ndarray, size: int):
    """For a shard of distinct blocks: (repeated, text of each window start, its place in the text, its key), by suffix array.

    `weights` says how often each text occurs in the corpus. A separator, which no
    window holds, stands after each text.
    """
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    firsts = np.cumsum(lens + 1) - lens - 1
    symbols = raw.astype(np.int64) + 1
    symbols[firsts + lens] = 0
    sa = suffix_array(symbols)
    lcp = common_prefixes(symbols, sa, size)
    counts = lens - size + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = firsts[owner] + inside
    group = np.empty(len(sa), np.int64)
    group[sa] = np.cumsum(lcp < size)
    mine = group[start]
    heavy = np.bincount(mine, weights=weights[owner])
    return heavy[mine] >= 2, owner, inside, Spans(raw).hash(start, start + size)


def _stretches(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last index of each stretch of rows with the same keys."""
    change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    edge = np.ones(min(1, len(keys[0])), bool)
    return np.flatnonzero(np.concatenate((edge, change))), np.flatnonzero(np.concatenate((change, edge)))


_RUNS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_SPAN = ["h", "s", "off", "n"]


def _keyed(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, tag, text): the tag tells rows of one id apart; rows with one id and one text are alike."""
    return documents.select(F.col(ident).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), F.coalesce(text, F.lit("")).alias("text"))


def repeated_ranges(documents: DataFrame, size: int = SIZE, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                    ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tag, ranges): byte ranges, from each start to its end, that repeated windows cover; documents without any have no row."""
    if gram & (gram - 1) or gram > size:
        raise ValueError("gram must be a power of two and at most size")
    spark = documents.sparkSession
    docs = _keyed(documents, ident, text)
    kind = dict(docs.dtypes)["id"]

    def find(batches):
        for rows, texts in slices(batches, "text"):
            pieces, row, base = [], [], []
            for i, t in enumerate(texts):
                for at in range(0, max(1, len(t) - size + 1), PIECE):
                    pieces.append(t[at:at + PIECE + size - 1])
                    row.append(i)
                    base.append(at)
            piece, start, n, off, h, s = blocks(pieces, size, gram, _PLACE_BITS)
            order = np.lexsort((n, off, s, h))  # blocks of one kind become one row with their places
            span = [x[order].view(np.int64) for x in (h, s, off, n)]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in span])
            first = np.flatnonzero(new)
            at = pa.array(np.array(row, np.int64)[piece[order]])
            places = pa.StructArray.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array((np.array(base, np.int64)[piece] + start)[order])], ["id", "tag", "start"])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in span), pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), places)],
                                             [*_SPAN, "places"])

    found = cut_lineage(docs.filter(F.octet_length("text") >= size).mapInArrow(
        find, f"h long, s long, off long, n long, places array<struct<id:{kind},tag:long,start:long>>"))
    kinds = found.groupBy(*_SPAN).agg(F.sum(F.size("places")).alias("c"), F.min(F.array_min("places")).alias("at"))
    anchors = kinds.groupBy("h").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") + size).alias("bytes"))
    kinds = cut_lineage(kinds.join(anchors.filter("total > 1"), "h"))
    copied = kinds.filter("c > 1").select(*_SPAN, F.lit(0).cast("long").alias("from"), F.col("n").alias("to"))

    mixed = kinds.filter("kinds > 1").withColumn("parts", F.ceil(F.col("bytes") / shard_bytes)).withColumn("part", F.pmod(F.xxhash64("s", "off", "n"), "parts"))
    wanted = mixed.groupBy(F.col("at.id").alias("id"), F.col("at.tag").alias("tag")).agg(
        F.collect_list(F.struct("h", "s", "off", "n", "c", "part", "parts", F.col("at.start").alias("start"))).alias("spans"))
    names = [*_SPAN, "c", "part", "parts"]

    def cut(batches):
        for rows, texts in slices(batches, "text"):
            spans = rows.column(rows.schema.get_field_index("spans")).to_pylist()
            every = [(x, t) for xs, t in zip(spans, texts) for x in xs]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x, _ in every], pa.int64()) for c in names]
                                             + [pa.array([t[x["start"]:x["start"] + x["n"] + size - 1] for x, t in every], pa.binary())], [*names, "bytes"])

    joined = docs.join(wanted, (docs["tag"] == wanted["tag"]) & docs["id"].eqNullSafe(wanted["id"])).select(docs["text"], wanted["spans"])
    count = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = joined.mapInArrow(cut, "h long, s long, off long, n long, c long, part long, parts long, bytes binary")
    shards = texts.repartition(count, "h", "part").sortWithinPartitions("h", "part", "s", "off", "n")

    def shard(batches):
        def work(held):
            rows = {c: np.array([x for h in held for x in h[c]], np.int64) for c in names}
            raw = [x for h in held for x in h["bytes"]]
            same = np.zeros(len(raw), bool)  # two alike rows bring a block twice
            same[1:] = np.logical_and.reduce([rows[c][1:] == rows[c][:-1] for c in _SPAN])
            keep = np.flatnonzero(~same)
            rows, raw = {c: v[keep] for c, v in rows.items()}, [raw[i] for i in keep]
            flags, owner, inside, key = repeated_windows(raw, rows["c"], size)
            some, place = owner[flags], inside[flags]
            first, last = _stretches(some)
            none = pa.nulls(len(first))
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[c][some[first]], pa.int64()) for c in _SPAN), pa.array(place[first], pa.int64()), pa.array(place[last] + 1, pa.int64()),
                                              none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary())], out)
            for h, part, parts in sorted(set(zip(rows["h"].tolist(), rows["part"].tolist(), rows["parts"].tolist()))):
                if parts < 2:
                    continue
                mine = np.flatnonzero((rows["h"] == h) & (rows["part"] == part))
                own = np.flatnonzero(np.isin(owner, mine))
                at = (key[own] % _U(parts)).astype(np.int64)
                for r in np.unique(at).tolist():  # sorted keys of each range of the merge
                    x = own[at == r]
                    x = x[np.argsort(key[x], kind="stable")]
                    who = np.column_stack([rows[c][owner[x]] for c in ("s", "off", "n")] + [inside[x]])
                    none1 = [pa.array([v], pa.int64()) for v in (h, None, None, None, None, None)]
                    yield pa.RecordBatch.from_arrays([*none1, pa.array([part], pa.int64()), pa.array([r], pa.int64()),
                                                      pa.array([key[x].tobytes()], pa.binary()), pa.array([who.astype(np.int64).tobytes()], pa.binary())], out)

        held, amount, now = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, part = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            sizes = np.array([len(x) for x in batch.column(7).to_pylist()])
            edges = np.concatenate(([0], np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1, [len(h)]))
            for a, b in zip(edges[:-1], edges[1:]):
                if (h[a], part[a]) != now and amount >= shard_bytes:
                    yield from work(held)
                    held, amount = [], 0
                now = (h[a], part[a])
                held.append(batch.slice(a, b - a).to_pydict())
                amount += int(sizes[a:b].sum())
        if held:
            yield from work(held)

    out = [*_SPAN, "from", "to", "part", "range", "keys", "who"]
    decided_schema = "h long, s long, off long, n long, from long, to long"
    sharded = cut_lineage(shards.mapInArrow(shard, f"{decided_schema}, part long, range long, keys binary, who binary"))

    def merge(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
        who = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in table["who"].to_pylist()]
        every = np.sort(np.concatenate([np.unique(k) for k in keys]))
        hits = []
        for k, x in zip(keys, who):  # a key that another shard holds too
            twice = np.searchsorted(every, k, "right") - np.searchsorted(every, k, "left") > 1
            hits.append(x[twice])
        x = np.concatenate(hits)
        s, off, n, place = x[np.lexsort(x.T[::-1])].T
        first, last = _stretches(s, off, n)
        h = table["h"][0].as_py()
        return pa.table({"h": pa.array([h] * len(first), pa.int64()), "s": s[first], "off": off[first], "n": n[first], "from": place[first], "to": place[last] + 1})

    merged = sharded.filter("range IS NOT NULL").select("h", "range", "part", "keys", "who").groupBy("h", "range").applyInArrow(
        merge, decided_schema)
    local = sharded.filter("range IS NULL").select(*_SPAN, "from", "to")
    decided = cut_lineage(copied.unionByName(local).unionByName(merged).groupBy(*_SPAN).agg(F.min("from").alias("from"), F.max("to").alias("to")))
    hits = found.join(decided, _SPAN).select("from", "to", F.explode("places").alias("at"))
    return hits.groupBy(F.col("at.id").alias("id"), F.col("at.tag").alias("tag")).agg(F.sort_array(F.collect_set(F.struct(
        (F.col("at.start") + F.col("from")).alias("from"), (F.col("at.start") + F.col("to") - 1 + size).alias("to")))).alias("ranges"))


def remove_repeats(documents: DataFrame, size: int = SIZE, ident: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) of every document: maximal removed byte runs and the bytes that stay.

    Repeats are judged on the input as it came. Null and short texts keep all they
    have. Rows that share an id are judged one by one. Other columns are not read.
    """
    ranges = repeated_ranges(documents, size, ident=ident, text=text, **how)
    docs = _keyed(documents, ident, text)
    kind = dict(docs.dtypes)["id"]

    def remove(batches):
        for rows, texts in slices(batches, "text"):
            spans, kept = [], []
            for t, ranges in zip(texts, rows.column(rows.schema.get_field_index("ranges")).to_pylist()):
                merged: list[dict] = []
                for r in sorted(ranges or [], key=lambda r: r["from"]):
                    if merged and r["from"] <= merged[-1]["to"]:
                        merged[-1]["to"] = max(merged[-1]["to"], r["to"])
                    else:
                        merged.append(dict(r))
                spans.append(merged)
                cuts = [0, *(x for r in merged for x in (r["from"], r["to"])), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            size_of = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size_of), pa.array(size_of - np.array([len(k) for k in kept], np.int64)),
                                              pa.array(spans, _RUNS), pa.array(kept, pa.binary())], [ident, "n_bytes", "n_removed", "spans", "kept"])

    joined = docs.join(ranges, (docs["tag"] == ranges["tag"]) & docs["id"].eqNullSafe(ranges["id"]), "left").select(docs["id"], docs["text"], ranges["ranges"])
    return joined.mapInArrow(remove, f"{ident} {kind}, n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept binary")

