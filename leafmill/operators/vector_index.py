"""Approximate nearest vectors: an inverted file with product-quantised residuals.

Centroids come from rounds of k-means over a bounded sample, each round a Spark job whose
tasks give sums per centroid. Every vector goes to the list of its nearest centroid; what
the centroid leaves over is coded by one byte per stretch of its numbers. A search reads
the codes of the lists nearest to each query, keeps the best by code, and scores only
those with their stored vectors. Lists are folders, so lists that no query asks for are not read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import fixed_values as fv
from leafmill.functions.ordered import top_k
from leafmill.operators import nearest as nn
from leafmill.session import cut_lineage, shared_dir

#: Vectors that centroids and codes are fitted on, at most about; lists at most; rounds of k-means; codes of a stretch.
SAMPLE, MOST_LISTS, ROUNDS, CODES = 65_536, 4096, 5, 256
#: Numbers of a vector under one code.
STRETCH = 2
#: Rows of a group of lists that a task meets at a time; bytes of stored vectors a file holds, about.
GROUP_ROWS, FILE_BYTES = 262_144, 64 << 20


@dataclass(frozen=True)
class VectorIndex:
    """Stored rows (list, id, code, embedding) in a folder per list, and the bounded tables that read them."""

    rows: DataFrame
    sizes: list[int]
    centroids: np.ndarray
    codebooks: np.ndarray
    vector_id: str


def nearest_of(rows: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the n nearest centres of each row, nearest first; equally near ones by number."""
    away = (centres * centres).sum(1)[None, :] - 2 * (rows @ centres.T)
    if n == 1:
        return away.argmin(1)[:, None]
    return np.argsort(away, axis=1, kind="stable")[:, :n]


def _vectors(batch, column: str, dim: int, element: str):
    import pyarrow.compute as pc

    values = batch.column(column)
    if pc.any(pc.not_equal(pc.list_value_length(values), dim)).as_py():
        raise ValueError(f"a vector is not of length {dim}")
    return nn.unit_rows(np.asarray(values.flatten().to_numpy(zero_copy_only=False), element).tobytes(), dim, element)


def fit_centroids(sample: DataFrame, dim: int, lists: int, rounds: int = ROUNDS, ident: str = "chunk_id") -> np.ndarray:
    """k-means of unit vectors: (centroids, dim), from `lists` rows of the sample picked by hash. A round is one job; its sums are added by key."""
    import pyarrow as pa

    element = nn.element_of(sample, "embedding")
    start = sample.orderBy(F.xxhash64(ident), ident).limit(lists).select("embedding").collect()  # at most MOST_LISTS rows
    centres = np.array([r[0] for r in start], np.float64).reshape(len(start), dim)
    centres /= np.maximum(np.sqrt((centres * centres).sum(1)), 1e-300)[:, None]
    for _ in range(rounds):
        held = centres

        def sums(batches):
            total, count = np.zeros_like(held), np.zeros(len(held), np.int64)
            for batch in batches:
                x, real = _vectors(batch, "embedding", dim, element)
                at = nearest_of(x[real], held)[:, 0]
                np.add.at(total, at, x[real])
                count += np.bincount(at, minlength=len(held))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array([t.tobytes() for t in total[used]], pa.binary())], ["list", "n", "total"])

        def added(table):
            total = np.sum([np.frombuffer(t) for t in table["total"].to_pylist()], axis=0) / sum(table["n"].to_pylist())
            return pa.table({"list": table["list"][:1], "centre": pa.array([total.tobytes()], pa.binary())})

        moved = sample.select("embedding").mapInArrow(sums, "list int, n long, total binary").groupBy("list").applyInArrow(added, "list int, centre binary")
        centres = centres.copy()
        for r in moved.collect():  # a row per centroid
            centres[r["list"]] = np.frombuffer(bytes(r["centre"]))
    return centres


def _stretch_bounds(dim: int, parts: int) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


def fit_codebooks(sample: DataFrame, dim: int, centroids: np.ndarray, parts: int, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, CODES, widest stretch): k-means per stretch of what centroids leave over; each stretch is a task of its own."""
    import pyarrow as pa

    element, bounds = nn.element_of(sample, "embedding"), _stretch_bounds(dim, parts)
    widest = max(b - a for a, b in zip(bounds, bounds[1:]))

    def cut(batches):
        for batch in batches:
            x, real = _vectors(batch, "embedding", dim, element)
            x = x[real]
            x = (x - centroids[nearest_of(x, centroids)[:, 0]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x[:, a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["part", "rows"])

    def fit(table):
        part = table["part"][0].as_py()
        wide = bounds[part + 1] - bounds[part]
        rows = np.sort(np.concatenate([np.frombuffer(r, np.float32) for r in table["rows"].to_pylist()]).reshape(-1, wide).view([("", np.float32)] * wide), axis=0)
        rows = rows.view(np.float32).reshape(-1, wide)  # in one order, whichever task came first
        book = rows[np.linspace(0, len(rows) - 1, CODES).astype(int)].copy() if len(rows) else np.zeros((CODES, wide), np.float32)
        for _ in range(rounds if len(rows) else 0):
            at = nearest_of(rows, book)[:, 0]
            n = np.bincount(at, minlength=CODES)
            for c in range(wide):
                book[:, c] = np.where(n > 0, np.bincount(at, rows[:, c], minlength=CODES) / np.maximum(n, 1), book[:, c])
        out = np.zeros((CODES, widest), np.float32)
        out[:, :wide] = book
        return pa.table({"part": pa.array([part], pa.int32()), "book": pa.array([out.tobytes()], pa.binary())})

    books = np.zeros((parts, CODES, widest), np.float32)
    fitted = sample.select("embedding").mapInArrow(cut, "part int, rows binary").groupBy("part").applyInArrow(fit, "part int, book binary")
    for r in fitted.collect():  # a row per stretch
        books[r["part"]] = np.frombuffer(bytes(r["book"]), np.float32).reshape(CODES, widest)
    return books


def encoded(vectors: DataFrame, dim: int, centroids: np.ndarray, books: np.ndarray, ident: str) -> DataFrame:
    """(list, ident, code, embedding): the nearest list, and the nearest code of each stretch. Map-only."""
    import pyarrow as pa

    element, parts = nn.element_of(vectors, "embedding"), len(books)
    bounds = _stretch_bounds(dim, parts)
    out = T.StructType([T.StructField("list", T.IntegerType()), vectors.schema[ident], T.StructField("code", T.BinaryType()), vectors.schema["embedding"]])

    def code(batches):
        for batch in batches:
            x, _ = _vectors(batch, "embedding", dim, element)
            at = nearest_of(x, centroids)[:, 0]
            x = (x - centroids[at]).astype(np.float32)
            codes = np.stack([nearest_of(x[:, a:b], books[i, :, :b - a])[:, 0] for i, (a, b) in enumerate(zip(bounds, bounds[1:]))], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(ident), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding")], out.names)

    return vectors.select(ident, "embedding").filter(F.col("embedding").isNotNull()).mapInArrow(code, out)


def build_index(vectors: DataFrame, dim: int, vector_id: str = "chunk_id", lists: int | None = None, parts: int | None = None,
                folder: str | None = None) -> VectorIndex:
    """Fit on a sample, code every vector, and write the rows to `folder`, by list.

    About the square root of the number of vectors are lists. The sample is every vector up
    to SAMPLE of them, and else those of a fixed share of hashes. Rows are dealt by ranges
    of (list, hash), so a list with a third of all rows is many files. Rows without a vector
    are left out; equal vectors share list and code. An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(vector_id, "embedding").filter(F.col("embedding").isNotNull())
    n = vectors.count()
    lists = max(1, min(MOST_LISTS, lists or round(math.sqrt(n))))
    parts = parts or max(1, dim // STRETCH)
    sample = vectors if n <= SAMPLE else cut_lineage(vectors.filter(F.pmod(F.xxhash64(vector_id), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n)))
    centroids = fit_centroids(sample, dim, lists, ident=vector_id)
    if not len(centroids):
        centroids = np.zeros((1, dim))
    books = fit_codebooks(sample, dim, centroids, parts)
    rows = cut_lineage(encoded(vectors, dim, centroids, books, vector_id))
    folder = folder or f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    files = max(spark.sparkContext.defaultParallelism, -(-n * dim * 4 // FILE_BYTES))
    rows.repartitionByRange(files, "list", F.xxhash64(vector_id)).sortWithinPartitions("list", vector_id).write.partitionBy("list").parquet(folder)
    stored = spark.read.schema(T.StructType([f for f in rows.schema if f.name != "list"] + [rows.schema["list"]])).parquet(folder)
    sizes = [0] * len(centroids)
    for r in rows.groupBy("list").count().collect():  # a row per list
        sizes[r["list"]] = r["count"]
    return VectorIndex(stored, sizes, centroids, books, vector_id)


def probed_lists(queries: DataFrame, centroids: np.ndarray, probes: int, query_id: str = "query_id") -> DataFrame:
    """(query_id, query_vector, lists): the `probes` lists nearest to each query with a vector."""
    import pyarrow as pa

    element, dim = nn.element_of(queries, "query_vector"), centroids.shape[1]
    out = T.StructType([queries.schema[query_id], queries.schema["query_vector"], T.StructField("lists", T.ArrayType(T.IntegerType()))])

    def probe(batches):
        for batch in batches:
            x, _ = _vectors(batch, "query_vector", dim, element)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_of(x, centroids, probes).tolist(), pa.list_(pa.int32()))], out.names)

    return queries.select(query_id, "query_vector").filter(F.col("query_vector").isNotNull()).mapInArrow(probe, out)


def _grouped(queries: DataFrame, layout: DataFrame) -> DataFrame:
    """A row per query and group of lists, with those of its lists that lie in the group."""
    names = [c for c in queries.columns if c != "lists"]
    each = queries.select(*names, F.explode("lists").alias("list")).join(layout, "list")
    spread = each.select(*names, "list", F.explode(F.sequence("first", F.col("first") + F.col("span") - 1)).alias("group"))
    ids = [c for c in names if c != "query_vector"]
    return spread.groupBy(*ids, "group").agg(F.first("query_vector").alias("query_vector"), F.collect_list("list").alias("lists"))


def scored_exactly(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, dim: int, query_id: str, vector_id: str, on: list[str]) -> DataFrame:
    """(query_id, vector_id, dense_score) of candidate pairs, from their vectors."""
    import pyarrow as pa

    elements = nn.element_of(queries, "query_vector"), nn.element_of(vectors, "embedding")
    pairs = candidates.join(vectors.select(*on, "embedding"), on).join(queries.select(query_id, "query_vector"), query_id)
    out = T.StructType([queries.schema[query_id], vectors.schema[vector_id], T.StructField("dense_score", T.DoubleType())])

    def score(batches):
        for batch in batches:
            q, a = _vectors(batch, "query_vector", dim, elements[0])
            v, b = _vectors(batch, "embedding", dim, elements[1])
            points = np.rint(np.einsum("ij,ij->i", q, v) * nn.SCALE) / nn.SCALE
            yield pa.RecordBatch.from_arrays([batch.column(query_id), batch.column(vector_id), pa.array(points)], out.names).filter(pa.array(a & b))

    return pairs.select(query_id, vector_id, "query_vector", "embedding").mapInArrow(score, out)


def code_candidates(index: VectorIndex, queries: DataFrame, probes: int, rescored: int, query_id: str = "query_id") -> DataFrame:
    """(query_id, vector_id, list, rank): of each query the `rescored` best by code in its `probes` nearest lists.

    Lists lie one after the other in groups of GROUP_ROWS rows; a long list spans several.
    A query goes to the groups that hold lists of its own, and there meets only those.
    """
    spark, vector_id, dim, parts = queries.sparkSession, index.vector_id, index.centroids.shape[1], len(index.codebooks)
    centroids, books, bounds = index.centroids.astype(np.float32), index.codebooks, _stretch_bounds(dim, parts)
    begins = np.cumsum(index.sizes) - np.array(index.sizes)
    ends = np.maximum(begins, np.cumsum(index.sizes) - 1)
    layout = spark.createDataFrame([(i, int(a), int(b - a + 1)) for i, (a, b) in enumerate(zip(begins // GROUP_ROWS, ends // GROUP_ROWS))],
                                   "list int, first int, span int")
    groups = int(ends[-1] // GROUP_ROWS) + 1
    shares = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups))
    asked = _grouped(probed_lists(queries, index.centroids, probes, query_id), layout).withColumn("share", F.pmod(F.xxhash64(query_id), F.lit(shares)).cast("int"))
    tasks = groups * shares
    q = nn.packed(asked.repartition(tasks, "group", "share").sortWithinPartitions("group", "share"), query_id, "query_vector", "q", dim, ("group", "share"), ("lists",))
    v = nn.packed(index.rows.select("list", vector_id, "code"), vector_id, "code", "v", parts, ("list",)).join(layout, "list").select(
        "list", "v_ids", "v_rows", (F.col("first") + F.pmod(F.xxhash64(F.get("v_ids", F.lit(0))), F.col("span"))).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    element = nn.element_of(queries, "query_vector")

    def query_rows(row):
        q, real = nn.unit_rows(row["q_rows"], dim, element)
        return q.astype(np.float32), real

    def vector_rows(row):
        codes = np.frombuffer(row["v_rows"], np.uint8).reshape(-1, parts)
        out = np.repeat(centroids[row["list"]][None, :], len(codes), 0)
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            out[:, a:b] += books[i, codes[:, i], :b - a]
        return out, np.ones(len(codes), bool)

    def asking(row):
        return np.array([row["list"] in mine for mine in row["q_lists"]], bool)

    pairs = q.repartition(tasks, "group", "share").hint("merge").join(v.repartition(tasks, "group", "share"), ["group", "share"])
    found = nn.best_of_pairs(pairs, rescored, query_id, vector_id, query_rows, vector_rows, asking, keep=("list",))
    return top_k(found, [query_id], [F.desc("dense_score"), F.asc(vector_id)], rescored).drop("dense_score")


def approximate_top_k(index: VectorIndex, queries: DataFrame, k: int = fv.BRANCH_LIMIT, probes: int | None = None, rescored: int | None = None,
                      query_id: str = "query_id") -> DataFrame:
    """(query_id, vector_id, dense_score, rank): the k best of the candidates by code, by their exact scores.

    By default a query reads three quarters of the lists, enough where vectors lie far apart
    in all directions; where they cluster far fewer do. `rescored` (5 * k) pairs per query
    are scored with whole vectors.
    """
    probes = min(len(index.centroids), probes or -(-3 * len(index.centroids) // 4))
    candidates = code_candidates(index, queries, probes, rescored or 5 * k, query_id).drop("rank")
    scored = scored_exactly(candidates, index.rows, queries, index.centroids.shape[1], query_id, index.vector_id, ["list", index.vector_id])
    return top_k(scored, [query_id], [F.desc("dense_score"), F.asc(index.vector_id)], k)


def listed_top_k(vectors: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, k: int = fv.BRANCH_LIMIT,
                 vector_id: str = "chunk_id", query_id: str = "query_id") -> DataFrame:
    """Exact top-k among the vectors of each query's `probes` nearest lists, for centroids given by the caller; nothing is coded or stored."""
    import pyarrow as pa

    dim, element = centroids.shape[1], nn.element_of(vectors, "embedding")
    out = T.StructType([T.StructField("list", T.IntegerType()), vectors.schema[vector_id], vectors.schema["embedding"]])

    def place(batches):
        for batch in batches:
            x, _ = _vectors(batch, "embedding", dim, element)
            yield pa.RecordBatch.from_arrays([pa.array(nearest_of(x, centroids)[:, 0], pa.int32()), *batch.columns], out.names)

    placed = vectors.select(vector_id, "embedding").filter(F.col("embedding").isNotNull()).mapInArrow(place, out)
    wanted = probed_lists(queries, centroids, probes, query_id).select(query_id, "query_vector", F.explode("lists").alias("list"))
    shares = queries.sparkSession.sparkContext.defaultParallelism
    q = nn.packed(wanted.repartition("list").sortWithinPartitions("list"), query_id, "query_vector", "q", dim, ("list",)).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    v = nn.packed(placed, vector_id, "embedding", "v", dim, ("list",)).withColumn("share", F.pmod(F.xxhash64(F.get("v_ids", F.lit(0))), F.lit(shares)).cast("int"))
    kinds = nn.element_of(queries, "query_vector"), element
    tasks = min(len(centroids), 8) * shares
    pairs = q.repartition(tasks, "list", "share").hint("merge").join(v.repartition(tasks, "list", "share"), ["list", "share"])
    found = nn.best_of_pairs(pairs, k, query_id, vector_id, lambda row: nn.unit_rows(row["q_rows"], dim, kinds[0]), lambda row: nn.unit_rows(row["v_rows"], dim, kinds[1]))
    return top_k(found, [query_id], [F.desc("dense_score"), F.asc(vector_id)], k)
