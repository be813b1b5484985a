"""Exact nearest vectors: blocks of queries and blocks of vectors meet by a join, and tasks multiply them.

No vector passes the driver. A block is one row with its ids and its vectors as bytes; a
pair of blocks is one row of the join, so a task holds a few pairs, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import fixed_values as fv
from leafmill.functions.ordered import top_k

BLOCK_ROWS = 1024  # rows of a block at most
GROUP_BYTES = 32 << 20  # vectors that one task meets at a time, about
HITS_HELD = 500_000  # hits a task gathers before it keeps the best of each query
SCALE = 1_000_000  # scores are rounded to six digits
SEEN = ["dept_id", "folder_id"]
ASKED = ["dept_id", "search_scope", "folder_ids"]


def packed(df: DataFrame, ident: str, vector: str, side: str, dim: int, keys: tuple[str, ...] = (), extras: tuple[str, ...] = (),
           rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most `rows` vectors that agree in `keys`: keys, {side}_ids, {side}_rows (bytes), {side}_{extra} lists.

    Inside a block rows go by id. A row without a vector is left out; a vector of another
    length than `dim` fails the job. Vectors are arrays of numbers or, as codes, `dim` bytes.
    """
    kind = df.schema[vector].dataType
    element = None if isinstance(kind, T.BinaryType) else "f4" if isinstance(kind.elementType, T.FloatType) else "f8"
    columns = [*keys, ident, vector, *extras]
    out = T.StructType([df.schema[c] for c in keys] + [T.StructField(f"{side}_ids", T.ArrayType(df.schema[ident].dataType)), T.StructField(f"{side}_rows", T.BinaryType())]
                       + [T.StructField(f"{side}_{c}", T.ArrayType(df.schema[c].dataType)) for c in extras])

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.is_valid(table[vector])).sort_by([(c, "ascending") for c in (*keys, ident)]).combine_chunks()
            n = table.num_rows
            if not n:
                continue
            values = table[vector].chunk(0)
            sizes = pc.binary_length(values) if element is None else pc.list_value_length(values)
            if pc.any(pc.not_equal(sizes, dim)).as_py():
                raise ValueError(f"a vector is not of length {dim}")
            raw = b"".join(values.to_pylist()) if element is None else np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=element).tobytes()
            width = len(raw) // n
            fresh = np.zeros(n, bool)
            fresh[0] = True
            for c in keys:
                key = table[c].to_numpy()
                fresh[1:] |= key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            cut = np.append(np.flatnonzero((np.arange(n) - first) % rows == 0), n)
            offsets = pa.array(cut, pa.int32())

            def lists(c):
                return pa.ListArray.from_arrays(offsets, table[c].chunk(0))

            yield pa.RecordBatch.from_arrays(
                [table[c].chunk(0).take(pa.array(cut[:-1])) for c in keys] + [lists(ident), pa.array([raw[width * a:width * b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())]
                + [lists(c) for c in extras], out.names)

    return df.select(*columns).mapInArrow(pack, out)


def element_of(df: DataFrame, vector: str) -> str:
    """How numpy reads the numbers of a vector column."""
    return "f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "f8"


def unit_rows(raw: bytes, dim: int, element: str):
    """(vectors of unit length, which of them have a direction)."""
    import numpy as np

    rows = np.frombuffer(raw, dtype=element).reshape(-1, dim).astype(np.float64)
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.maximum(size, 1e-300)[:, None], (size > 0) & np.isfinite(size)


def _visible(row):
    """Which vectors of a pair of blocks each query may see; departments and folders as numbers of the block."""
    import numpy as np
    import pandas as pd

    scope = np.array(row["q_search_scope"], dtype=object)
    wanted = pd.Index(pd.unique(pd.Series([d for d in row["v_dept_id"] if d is not None], dtype=object)))
    theirs = wanted.get_indexer(pd.Index(row["v_dept_id"], dtype=object))
    mine = wanted.get_indexer(pd.Index(row["q_dept_id"], dtype=object))
    same = (mine[:, None] == theirs[None, :]) & (theirs >= 0)[None, :]
    names = pd.Index(pd.unique(pd.Series([f for f in row["v_folder_id"] if f is not None], dtype=object)))
    held = [f or [] for f in row["q_folder_ids"]]
    owner = np.repeat(np.arange(len(held)), [len(f) for f in held])
    at = names.get_indexer(pd.Index([x for f in held for x in f], dtype=object))
    grants = np.zeros((len(held), len(names) + 1), bool)  # the last column: no folder
    grants[owner[at >= 0], at[at >= 0]] = True
    granted = grants[:, names.get_indexer(pd.Index(row["v_folder_id"], dtype=object))]
    return np.where((scope == "dept")[:, None], same, np.where((scope == "folder")[:, None], granted, same | granted))


def best_of_pairs(pairs: DataFrame, k: int, query_id: str, vector_id: str, query_rows: Callable, vector_rows: Callable,
                  asking: Callable | None = None, visible: Callable | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, vector_id, dense_score, keep...): the k best of each query block among the vector blocks that follow each other.

    `pairs` has the columns of two `packed` tables, sides q and v; `query_rows` and
    `vector_rows` give (vectors, which are usable) of a row of it, `asking` which queries of
    the block meet this block at all, `visible` which vectors each of those may see. `keep`
    names columns of the pair that its hits carry. Scores are rounded, and equal ones go by
    id, so any split of the vectors into blocks gives the same best.
    """
    held, scale = HITS_HELD, SCALE
    ids = pairs.schema["q_ids"].dataType.elementType, pairs.schema["v_ids"].dataType.elementType
    out = T.StructType([T.StructField(query_id, ids[0]), T.StructField(vector_id, ids[1]), T.StructField("dense_score", T.DoubleType())] + [pairs.schema[c] for c in keep])

    def score(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        nothing = np.iinfo(np.int64).min
        last, q, usable, names, least, found, hits = None, None, None, None, None, [], 0

        def merged():
            rows = pd.concat(found).sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable").groupby("q").head(k)
            full = rows[rows.groupby("q").cumcount() == k - 1]
            least[full["q"].to_numpy()] = full["score"].to_numpy()
            return rows

        def given():
            rows = merged()
            columns = [names.take(pa.array(rows["q"].to_numpy())), pa.array(rows["id"], pa_id), pa.array(rows["score"].to_numpy() / scale)]
            return pa.RecordBatch.from_arrays(columns + [pa.array(rows[c], pa_keep[c]) for c in keep], out.names)

        for batch in batches:
            pa_id = batch.schema.field("v_ids").type.value_type
            pa_keep = {c: batch.schema.field(c).type for c in keep}
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in one.schema.names if c not in ("q_ids", "v_ids")}
                if last is None or row["q_rows"] != last[0] or not one.column("q_ids").equals(last[1]):
                    if found:
                        yield given()
                    last, (q, usable), names = (row["q_rows"], one.column("q_ids")), query_rows(row), one.column("q_ids").flatten()
                    least, found, hits = np.full(len(q), nothing), [], 0
                v, real = vector_rows(row)
                theirs = one.column("v_ids").flatten().to_numpy(zero_copy_only=False)
                some = np.arange(len(q)) if asking is None else np.flatnonzero(asking(row))
                if not len(some):
                    continue
                keys = np.rint((q[some] @ v.T) * scale)
                fits = usable[some][:, None] & real[None, :]
                if visible is not None:
                    fits &= visible(row)[some]
                keys[~fits] = -scale * 4  # below any score; unit vectors without a direction are zeros
                keys = keys.astype(np.int64) * len(v) - np.arange(len(v))  # equal scores: the smaller id, as blocks go by id
                at = np.argpartition(keys, -k, axis=1)[:, -k:] if len(v) > k else np.broadcast_to(np.arange(len(v)), keys.shape)
                line, col = np.repeat(np.arange(len(some)), at.shape[1]), at.ravel()
                asked, points = some[line], -(-keys[line, col] // len(v))  # back to the rounded score
                good = fits[line, col] & (points >= least[asked])
                if good.any():
                    found.append(pd.DataFrame({"q": asked[good], "id": theirs[col[good]], "score": points[good], **{c: row[c] for c in keep}}))
                    hits += int(good.sum())
                if hits > held:
                    found = [merged()]
                    hits = len(found[0])
        if found:
            yield given()

    return pairs.mapInArrow(score, out)


def dense_top_k(vectors: DataFrame, queries: DataFrame, dim: int, k: int = fv.BRANCH_LIMIT,
                vector_id: str = "chunk_id", query_id: str = "query_id", access: bool = False) -> DataFrame:
    """Exact cosine top-k of every query over all vectors: (query_id, vector_id, dense_score, rank).

    Vector blocks are dealt to groups of about GROUP_BYTES, and every query block goes to
    every group; where there are fewer groups than cores the queries are dealt too. A task
    gives k rows per query and group, which are ranked again: a top-k of top-k.

    `vectors` needs vector_id, embedding; `queries` needs query_id, query_vector, with ids
    that occur once. With `access`, vectors also need dept_id, folder_id and queries
    dept_id, search_scope, folder_ids, and a pair counts only if the query may see it.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-vectors.count() * dim * 4 // GROUP_BYTES))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    shares = max(1, min(blocks, -(-2 * cores // groups)))

    def dealt(ids, n):
        return F.pmod(F.xxhash64(F.get(ids, F.lit(0))), F.lit(n)).cast("int")

    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    q = packed(queries, query_id, "query_vector", "q", dim, extras=tuple(ASKED) if access else ()).select(
        "*", dealt("q_ids", shares).alias("share"), every.alias("group"))
    v = packed(vectors, vector_id, "embedding", "v", dim, extras=tuple(SEEN) if access else ()).select(
        "*", dealt("v_ids", groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    kinds = {"q": element_of(queries, "query_vector"), "v": element_of(vectors, "embedding")}
    parts = groups * shares
    pairs = q.repartition(parts, "group", "share").hint("merge").join(v.repartition(parts, "group", "share"), ["group", "share"])
    found = best_of_pairs(pairs, k, query_id, vector_id, lambda row: unit_rows(row["q_rows"], dim, kinds["q"]),
                          lambda row: unit_rows(row["v_rows"], dim, kinds["v"]), visible=_visible if access else None)
    return top_k(found, [query_id], [F.desc("dense_score"), F.asc(vector_id)], k)


def recall_against(approximate: DataFrame, exact: DataFrame, vector_id: str = "chunk_id", query_id: str = "query_id") -> DataFrame:
    """Per query: how many of the exact top-k the approximate search also found."""
    both = exact.select(query_id, vector_id).join(
        approximate.select(query_id, vector_id, F.lit(1).alias("found")), [query_id, vector_id], "left")
    return both.groupBy(query_id).agg(F.count(F.lit(1)).alias("expected"), F.count("found").alias("found"))
