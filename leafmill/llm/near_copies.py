"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection of sorted arrays.

1. Each text becomes its sorted set of hashed shingles; equal sets are one class.
2. Two sets that link share a shingle among the first n - ceil(t n) + 1 of each, in any
   one order. The order puts frequent shingles last, by counts over all documents. So
   classes meet under the shingles of that prefix. In a tile of one shingle (and one
   band of sizes, if many hold it) bitmaps bound each overlap from above; what passes
   joins two classes to a cluster, and a tile of g classes gives g - 1 rows at most.
3. Every link lies within a cluster. The texts of a cluster go to one task, which
   intersects the sorted arrays of pairs that are not yet connected.
4. A cluster too large for a task is dealt by two hashes in turn, and what the parts of
   both have connected is one; only pairs across what is left apart are then listed, tile
   by tile, and intersected one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.llm.common import free_name, grams, hash_words, mix, rows_of, slices
from leafmill.llm.components import components
from leafmill.session import cut_lineage

SHINGLE, PERCENT = 5, 80
#: Counters of the frequency table (fixed, whatever the corpus), bits of the smallest signature.
COUNTERS, BITS = 1 << 20, 256
#: Shingles a task holds before it passes them on; members of a star that one task compares; rows of a tile compared at once.
HELD, STAR_PART, BLOCK = 1_000_000, 256, 512
#: Classes under one shingle from which it is dealt by bands of sizes; members and shingles of a cluster that one task compares.
MANY, CLUSTER, CLUSTER_SHINGLES = 2000, 4000, 6_000_000
_U = np.uint64


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted within it; how many each has)."""
    owner, _, _, hashes, _ = hash_words(texts)
    words = np.bincount(owner, minlength=len(texts))
    values, where = grams(hashes, n), owner[:max(0, len(owner) - n + 1)]
    whole = owner[n - 1:] == where if len(values) else np.zeros(0, bool)
    values, where = [values[whole]], [where[whole]]
    first = np.cumsum(words) - words
    for size in range(1, n):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(words == size)
        if len(short):
            values.append(np.array([grams(hashes[i:i + size], size)[0] for i in first[short]], np.uint64) ^ _U(size))
            where.append(short)
    values, where = np.concatenate(values), np.concatenate(where)
    order = np.lexsort((values, where))
    values, where = values[order], where[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (where[1:] != where[:-1])
    return values[new], np.bincount(where[new], minlength=len(texts)).astype(np.int64)


def _each(values: np.ndarray, counts: np.ndarray, reduce, empty) -> np.ndarray:
    """`reduce` (a ufunc) over the values of each text."""
    out = np.full(len(counts), empty, values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = reduce.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def set_ids(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, whatever text it came from."""
    return mix(_each(mix(values), counts, np.add, 0) + counts.astype(np.uint64)).view(np.int64)


def signatures(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bitmaps of parities: two sets differ in at least as many shingles as their bitmaps in bits.

    A bitmap has about as many bits as the set has members, the nearest power of two, and
    BITS at least; a wider one folds to a narrower by xor of its halves.
    """
    width = np.maximum(BITS, 1 << np.rint(np.log2(np.maximum(1, counts))).astype(np.int64))
    ends = np.cumsum(width)
    place = np.repeat(ends - width, counts) + (values >> _U(20)).astype(np.int64) % np.repeat(width, counts)
    odd = np.packbits((np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[(e - w) // 8:e // 8] for e, w in zip(ends.tolist(), width.tolist())]


class Bitmaps:
    """Signatures of a group; a pair is compared at the width of the narrower one."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.width, self.at = raw, np.array([len(b) for b in raw], np.int64), {}

    def _rows(self, which: np.ndarray, width: int) -> np.ndarray:
        if width not in self.at:  # sets that may link differ in width by a factor of two at most
            mine = np.flatnonzero((self.width == width) | (self.width == 2 * width))
            place = np.full(len(self.raw), -1)
            place[mine] = np.arange(len(mine))
            self.at[width] = place, np.stack([np.bitwise_xor.reduce(np.frombuffer(self.raw[k], np.uint64).reshape(-1, width // 8), axis=0) for k in mine])
        place, rows = self.at[width]
        return rows[place[which]]

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair how many bits differ: no more than shingles do."""
        width, out = np.minimum(self.width[i], self.width[j]), np.zeros(len(i), np.int64)
        for w in np.unique(width).tolist():
            m = width == w
            out[m] = np.bitwise_count(self._rows(i[m], w) ^ self._rows(j[m], w)).sum(axis=1, dtype=np.int64)
        return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _describe(documents: DataFrame, n: int, ident: str, text: str) -> DataFrame:
    """A row per document (id, key, n, set, bitmap) and, per task, rows of the frequency table (part, counts).

    The key, a hash of id and text, tells rows of one id, and those without one, apart.
    """
    kind = dict(documents.dtypes)[ident]
    names = [ident, "key", "n", "set", "bits", "part", "counts"]
    id_type = to_arrow_type(documents.schema[ident].dataType)

    def run(batches):
        table = np.zeros(COUNTERS, np.int64)
        for rows, texts in slices(batches, "_text"):
            values, counts = shingle_sets(texts, n)
            table += np.bincount((values >> _U(44)).astype(np.int64), minlength=COUNTERS)
            none = pa.nulls(len(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _long(counts), _long(set_ids(values, counts)),
                                              pa.array(signatures(values, counts), pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        parts = np.array_split(table.astype(np.uint32), 64)
        some = [k for k, p in enumerate(parts) if p.any()]
        none = pa.nulls(len(some))
        yield pa.RecordBatch.from_arrays([none.cast(id_type), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()),
                                          pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], names)

    return documents.select(ident, F.xxhash64(ident, text).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"{ident} {kind}, key long, n long, set long, bits binary, part int, counts binary")


def _classes(described: DataFrame) -> np.ndarray:
    """For each counter, how much fuller than usual it is, in powers of two: 1 MB, whatever the corpus."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.uint32).astype(np.int64) for b in table["counts"].to_pylist())
        return pa.table({"part": table["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = described.filter("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    table = np.zeros(COUNTERS, np.int64)
    cuts = np.cumsum([0] + [len(p) for p in np.array_split(table, 64)])
    for r in rows:
        table[cuts[r["part"]]:cuts[r["part"] + 1]] = np.frombuffer(r["counts"], np.int64)
    usual = max(1.0, 2.0 * table.mean())
    return np.floor(np.log2(np.maximum(1.0, table / usual))).astype(np.uint8)


def _prefixes(documents: DataFrame, classes, n: int, percent: int, buckets: int, text: str) -> DataFrame:
    """(key, set, held) for every prefix shingle that `held` classes, two or more, hold."""
    def emit(keys, sets):
        keys, sets = np.concatenate(keys), np.concatenate(sets)
        bucket = (keys % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        parts = [order[cuts[b]:cuts[b + 1]] for b in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                                           pa.array([sets[p].tobytes() for p in parts], pa.binary())], ["bucket", "keys", "sets"])

    def run(batches):
        table, keys, sets, held = classes.value, [], [], 0
        for _, texts in slices(batches, text):
            values, counts = shingle_sets(texts, n)
            ids = set_ids(values, counts)
            _, first = np.unique(ids, return_index=True)  # copies within the slice count once
            own = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((values, table[(values >> _U(44)).astype(np.int64)], own))
            rank = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
            wanted = counts - -(-percent * counts // 100) + 1
            once = np.zeros(len(counts), bool)
            once[first] = True
            chosen = (rank < wanted[own]) & once[own]  # `own` is sorted, so ranks fit the new order
            keys.append(values[order][chosen])
            sets.append(ids[own[chosen]])
            held += int(chosen.sum())
            if held > HELD:
                yield emit(keys, sets)
                keys, sets, held = [], [], 0
        if held:
            yield emit(keys, sets)

    def shared(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        sets = np.frombuffer(b"".join(table["sets"].to_pylist()), np.int64)
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
        keys, sets = keys[new], sets[new]
        same = keys[1:] == keys[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        held = np.repeat(np.diff(np.append(first, len(keys))), np.diff(np.append(first, len(keys))))
        return pa.table({"key": keys[many].view(np.int64), "set": sets[many], "held": held[many]})

    return documents.select(text).mapInArrow(run, "bucket int, keys binary, sets binary").groupBy("bucket").applyInArrow(shared, "key long, set long, held long")


def links_among(pairs: DataFrame, texts: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """Those `pairs` (a, b) of classes whose sets link, by exact intersection.

    Pairs of one `a` are a star: its text goes once to each part of at most about
    STAR_PART members, whose texts stream past it.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_PART).alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    members = dealt.select("a", "part", F.lit(1).alias("turn"), F.col("b").alias("set"))
    centres = dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("turn"), F.col("a").alias("set"))
    rows = members.unionByName(centres).join(texts.select("set", text), "set")
    count = max(1, pairs.sparkSession.sparkContext.defaultParallelism)
    count = max(count, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartition(count, "a", "part").sortWithinPartitions("a", "part", "turn")

    def run(batches):
        centre, own = None, np.zeros(0, np.uint64)
        for batch, raw in slices(batches, text):
            values, counts = shingle_sets(raw, n)
            ends = np.cumsum(counts)
            a, turn, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "turn", "set"))
            found = []
            for i in range(len(raw)):
                mine = values[ends[i] - counts[i]:ends[i]]
                if turn[i] == 0:
                    centre, own = a[i], mine
                elif a[i] == centre and 100 * min(len(own), len(mine)) >= percent * max(len(own), len(mine)):
                    both = _common(own, mine)
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        found.append((a[i], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return sorted_rows.mapInArrow(run, "a long, b long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Members of both sorted arrays."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def _root(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _tiles(rows: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (a, b) of classes that sizes and bitmaps let pass in a tile; `rows` are (key, set, held, n, label, bits).

    `every`: all pairs of different labels; else one row for each class that a tile joins to another, no more.
    A shingle that many classes hold is dealt by bands of sizes; each band also sees the one below.
    """
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    banded = rows.withColumn("band", F.floor(F.log("n") / step).cast("long"))
    many = F.col("held") > MANY
    twice = banded.withColumn("up", F.explode(F.when(many, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    tiled = twice.withColumn("tile", F.when(many, F.col("band") + F.col("up")).otherwise(F.lit(0)))
    count = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = tiled.select("key", "tile", "up", "set", "n", "label", "bits").repartition(count, "key", "tile").sortWithinPartitions("key", "tile", "n", "set")

    def pairs_of(group):
        ids, size, label, up = (np.concatenate([g[i] for g in group]) for i in range(4))
        bits, out = None, []
        for at in range(0, len(ids), BLOCK):
            own = np.arange(at, min(at + BLOCK, len(ids)))
            for from_ in range(0, at + 1, BLOCK):
                other = np.arange(from_, min(from_ + BLOCK, len(ids)))
                i, j = np.nonzero((other[None, :] < own[:, None]) & (label[own][:, None] != label[other][None, :])
                                  & (up[own][:, None] + up[other][None, :] < 2)
                                  & (100 * size[other][None, :] >= percent * size[own][:, None]))
                if len(i):
                    bits = Bitmaps([b for g in group for b in g[4]]) if bits is None else bits
                    i, j = own[i], other[j]
                    fits = _fit(bits.differ(i, j), size[i], size[j], percent)
                    out.append((ids[i[fits]], ids[j[fits]]))
        return out

    def run(batches):
        group, now, parent = [], None, {}

        def told(found):
            """The pairs, or those that join two of this task's clusters."""
            a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            a, b = np.minimum(a, b), np.maximum(a, b)
            if every:
                both = np.unique(np.column_stack([a, b]), axis=0)
            else:
                both = []
                for x, y in zip(a.tolist(), b.tolist()):
                    p, q = _root(parent, x), _root(parent, y)
                    if p != q:
                        parent[q] = p
                        both.append((x, y))
                both = np.array(both, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = batch.column(6).to_pylist()
            columns = (batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(2).to_numpy(), bits)
            edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1, [len(key)]))
            found = []
            for s, e in zip(edges[:-1], edges[1:]):
                if now != (key[s], tile[s]) and group:
                    found += pairs_of(group)
                    group = []
                now = (key[s], tile[s])
                group.append(tuple(c[s:e] for c in columns))
            yield told(found)
        if group:
            yield told(pairs_of(group))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _fit(differ: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether bitmaps leave room for a link: the overlap is at most (n + m - differing bits) / 2."""
    most = (n + m - differ) // 2
    return 100 * most >= percent * (n + m - most)


def _links(sets: list[np.ndarray], marks: list[bytes], ids: list[int], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect classes (sorted arrays and bitmaps) of different labels: each pair is looked at unless it is connected already."""
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    counts = size[order]
    bits = Bitmaps([marks[k] for k in order])
    _, label = np.unique(np.array(labels)[order], return_inverse=True)
    found = []
    for i in range(1, len(order)):
        open_ = np.flatnonzero((label[:i] != label[i]) & (100 * counts[:i] >= percent * counts[i]))
        if not len(open_):
            continue
        differ = bits.differ(open_, np.full(len(open_), i))
        fits = _fit(differ, counts[open_], counts[i], percent)
        open_, differ = open_[fits], differ[fits]
        for j in open_[np.argsort(differ, kind="stable")].tolist():  # the likeliest first
            if label[j] == label[i]:
                continue
            both = _common(sets[order[i]], sets[order[j]])
            if 100 * both >= percent * (counts[i] + counts[j] - both):
                found.append((ids[order[j]], ids[order[i]]))
                label[label == label[j]] = label[i]
    return found


def dealt(members: DataFrame, salt: int) -> DataFrame:
    """`members` (set, cluster, n) with `part`: the part of its cluster, which a task can hold."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CLUSTER, F.sum("n") / CLUSTER_SHINGLES)).alias("parts"))
    return members.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("set", F.lit(salt)), "parts")).drop("parts")


def links_within(members: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """Links (a, b) that connect the members (cluster, part, set, label, text) of each part of a cluster."""
    count = max(members.sparkSession.sparkContext.defaultParallelism, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = members.select("cluster", "part", "set", "label", text).repartition(count, "cluster", "part").sortWithinPartitions("cluster", "part", "set")

    def run(batches):
        now, sets, marks, ids, labels = None, [], [], [], []

        def told():
            found = _links(sets, marks, ids, labels, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch, raw in slices(batches, text):
            values, counts = shingle_sets(raw, n)
            ends = np.cumsum(counts)
            bits = signatures(values, counts)
            place = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("cluster", "part", "set", "label")]
            for i, (cluster, part, name, label) in enumerate(zip(*place)):
                if now != (cluster, part):
                    yield told()
                    now, sets, marks, ids, labels = (cluster, part), [], [], [], []
                if not ids or ids[-1] != name:  # two alike rows bring a set twice
                    sets.append(values[ends[i] - counts[i]:ends[i]].copy())
                    marks.append(bits[i])
                    ids.append(name)
                    labels.append(label)
        yield told()

    return rows.mapInArrow(run, "a long, b long")


def _linked(documents: DataFrame, n: int, percent: int, ident: str, text: str) -> DataFrame:
    """(id, key, n_shingles, label) of every document: equal labels are linked; without shingles it is null."""
    spark = documents.sparkSession
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    described = cut_lineage(_describe(documents, n, ident, text))
    docs = described.filter("part IS NULL")
    classes = spark.sparkContext.broadcast(_classes(described))
    sets = cut_lineage(docs.filter("n > 0").groupBy("set").agg(F.min("key").alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    shared = cut_lineage(_prefixes(documents, classes, n, percent, buckets, text))
    facts = sets.select("set", "n", "bits")
    near = _tiles(shared.join(facts, "set").withColumn("label", F.col("set")), percent, every=False)
    clusters = components(near).select(F.col("node").alias("set"), F.col("label").alias("cluster"))
    members = cut_lineage(clusters.join(sets.select("set", "n", F.col("first").alias("key")), "set").withColumn("label", F.col("set")))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """`wanted` (key, set, ...) with the text of each set, once a task; only alike rows of one id have one key."""
        names = [c for c in wanted.columns if c != "key"] + [text]
        keyed = documents.select(F.xxhash64(ident, text).alias("key"), text)

        def same_set(batches):
            given = set()
            for batch, raw in slices(batches, text):
                values, counts = shingle_sets(raw, n)
                sets = batch.column(batch.schema.get_field_index("set")).to_numpy()
                fits = set_ids(values, counts) == sets
                for i, name in enumerate(sets.tolist()):
                    fits[i] = fits[i] and name not in given
                    given.add(name)
                yield batch.filter(pa.array(fits))

        rows = rows_of(keyed, wanted, "key").join(wanted, "key").select(*names)
        return rows.mapInArrow(same_set, rows.schema)

    found = cut_lineage(links_within(texts_of(dealt(members, 1)), n, percent, text))
    large = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter((F.col("c") > CLUSTER) | (F.col("s") > CLUSTER_SHINGLES))
    large = cut_lineage(members.join(large.select("cluster"), "cluster", "left_semi").drop("label"))
    if not large.isEmpty():  # what a task could not hold whole
        texts = cut_lineage(texts_of(large.select("key", "set")))
        for salt in (2, 3):
            known = components(found.join(large.select(F.col("set").alias("a")), "a", "left_semi")).withColumnRenamed("node", "set")
            labelled = cut_lineage(large.join(known, "set", "left").withColumn("label", F.coalesce("label", "set")))
            if salt == 2:
                found = cut_lineage(found.unionByName(links_within(dealt(labelled, salt).join(texts, "set"), n, percent, text)))
        rows = shared.join(labelled.select("set", "label"), "set")
        apart = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        rows = cut_lineage(rows.join(apart, "key", "left_semi")).join(facts, "set")
        more = cut_lineage(_tiles(rows, percent, every=True))
        found = cut_lineage(found.unionByName(links_among(more, texts, n, percent, text)))
    linked = components(found)
    named = docs.select(ident, "key", F.col("n").alias("n_shingles"), "set").join(linked.select(F.col("node").alias("set"), "label"), "set", "left")
    return named.select(ident, "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "set")).alias("label"))


def near_copies(documents: DataFrame, n: int = SHINGLE, percent: int = PERCENT, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document.

    component_id is the smallest id reachable by links of `percent` Jaccard or more.
    Null and empty texts have no shingles and link with nothing, so they are their own
    component. A row without an id gets the smallest id it is linked with, else null.
    Rows that share an id count as one row each and are linked if their sets are.
    """
    named = _linked(documents, n, percent, ident, text)
    least = named.filter("label IS NOT NULL").groupBy("label").agg(F.min(ident).alias("component_id"))
    return named.join(least, "label", "left").select(ident, "n_shingles", F.coalesce("component_id", ident).alias("component_id"))


def one_of_each(documents: DataFrame, n: int = SHINGLE, percent: int = PERCENT, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """`documents` with one row of each group of linked ones: that of the smallest id, rows without an id last.

    Rows are told apart by a hash of id and text, so a row never goes for the id it shares
    with another; of alike rows one stays. Rows without words are linked with nothing and
    all stay. Only hashes of dropped and of repeated rows are joined.
    """
    rows = cut_lineage(_linked(documents, n, percent, ident, text).filter("label IS NOT NULL").groupBy("label", "key").agg(F.min(ident).alias("id"), F.count("*").alias("n")))
    stays = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))).alias("_first"))
    judged = cut_lineage(rows.join(stays, "label").select("key", "n", (F.col("key") == F.col("_first.key")).alias("stays")).filter("NOT stays OR n > 1"))
    key = free_name(documents, "_key")
    keyed = documents.withColumn(key, F.xxhash64(ident, text))
    once = judged.filter("stays").select(F.col("key").alias(key))
    kept = keyed.join(judged.select(F.col("key").alias(key)), key, "left_anti")
    if not once.isEmpty():
        kept = kept.unionByName(rows_of(keyed, once, key).join(once, key, "left_semi").dropDuplicates([key]))
    return kept.select(*documents.columns)
