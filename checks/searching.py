"""Vectors, access and search (F, G1 to G10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import part, query, sql
from checks.standins import t
from checks.wording import page_line_blocks, sql_keywords
from leafmill.functions import fixed_values as fv
from leafmill.functions import text as tx
from leafmill.functions import vectors as vx
from leafmill.operators import access as ac
from leafmill.operators import nearest as nn
from leafmill.operators import retrieval as rt
from leafmill.operators import terms as tm
from leafmill.operators import vector_index as vi
from leafmill.plans import hybrid as hy
from leafmill.plans import indexing as ix

# --- vectors ---------------------------------------------------------------------


def sql_buckets(source: str, key: str, text: str) -> str:
    return f"""
  SELECT {key}, ('0x' || substr(h, 4 * i + 1, 4))::INTEGER % 1024 AS bucket, count(*)::DOUBLE AS w
  FROM (SELECT {key}, sha256(token) AS h, unnest(range(0, 8)) AS i FROM (
    SELECT {key}, unnest(CASE WHEN len(ws) = 0 THEN ['__empty__'] ELSE ws END) AS token
    FROM (SELECT {key}, {s.sql_words(f'lower({text})')} AS ws FROM {source}))) GROUP BY ALL"""


part("chunk_buckets", sql_buckets("chunks", "chunk_id", "content"), "chunks")
part("chunk_norms", "SELECT chunk_id, sqrt(sum(w * w)) AS size FROM chunk_buckets GROUP BY 1", "chunk_buckets")
part("query_buckets", sql_buckets("asked", "query_id", "query_text"), "asked")
part("query_norms", "SELECT query_id, sqrt(sum(w * w)) AS size FROM query_buckets GROUP BY 1", "query_buckets")


def chunks(spark, sf):
    return ix.text_chunk_table(t(spark, sf, "documents"))


@query("f1_hash_embedding", sql("chunk_buckets", body="""
  SELECT chunk_id, count(*) AS n_buckets, sum(w)::BIGINT AS total, sum(w * bucket)::BIGINT AS weighted, sum(w * w * bucket)::BIGINT AS squared
  FROM chunk_buckets GROUP BY 1"""))
def f1(spark, sf):
    rows = ix.with_vectors(chunks(spark, sf)).select("chunk_id", "embedding")
    long = rows.select("chunk_id", F.posexplode("embedding").alias("bucket", "w")).filter("w > 0")
    w = F.col("w").cast("double")
    return long.groupBy("chunk_id").agg(F.count("*").alias("n_buckets"), F.sum(w).cast("long").alias("total"),
                                        F.sum(w * F.col("bucket")).cast("long").alias("weighted"),
                                        F.sum(w * w * F.col("bucket")).cast("long").alias("squared"))


@query("f2_l2_normalise", """
  SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos, round(unnest(e) * (1 + label) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * (1 + label)), 6) AS value
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)""")
def f2(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label")))
    rows = t(spark, sf, "embeddings").select("vec_id", F.posexplode(vx.l2_normalise(scaled)).alias("pos", "value"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("f3_cosine_to_centroid", """
  WITH long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
  centre AS (SELECT label, pos, avg(x) AS c FROM long GROUP BY ALL)
  SELECT vec_id, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 6) AS cosine
  FROM long JOIN centre USING (label, pos) GROUP BY vec_id""")
def f3(spark, sf):
    rows = t(spark, sf, "embeddings")
    long = rows.select("label", F.posexplode("embedding").alias("pos", "x"))
    centre = long.groupBy("label", "pos").agg(F.avg("x").alias("c")).groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda p: p["c"]).alias("centre"))
    return rows.join(centre, "label").select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


def vectors_and_queries(spark, sf):
    rows = t(spark, sf, "embeddings")
    return (rows.select(F.col("vec_id").alias("chunk_id"), "embedding"),
            rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")))


VECTOR_INDEXES = {}


def vector_index(spark, sf):
    """The inverted file of the embeddings: written once per session and folder, then read by every search."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in VECTOR_INDEXES:
        VECTOR_INDEXES[key] = vi.build_index(vectors_and_queries(spark, sf)[0], 64)
    return VECTOR_INDEXES[key]


def fiftieth(spark, sf):
    """The queries of a search: every vector whose id is divisible by 50."""
    return vectors_and_queries(spark, sf)[1].filter("query_id % 50 = 0")


@query("f4_approximate_nearest")
def f4a(spark, sf):
    return vi.approximate_top_k(vector_index(spark, sf), fiftieth(spark, sf))


@query("f4_recall")
def f4b(spark, sf):
    vectors, _ = vectors_and_queries(spark, sf)
    asked = fiftieth(spark, sf)
    return nn.recall_against(vi.approximate_top_k(vector_index(spark, sf), asked), nn.dense_top_k(vectors, asked, 64))


@query("f4_vector_lists", """
  SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids, sum(len(embedding)) * 4 AS n_bytes, sum(len(embedding)) // 2 AS code_bytes FROM embeddings""")
def f4c(spark, sf):
    rows = vector_index(spark, sf).rows
    return rows.agg(F.count("*").alias("n_vectors"), F.count_distinct("chunk_id").alias("n_ids"), (F.sum(F.size("embedding")) * 4).alias("n_bytes"),
                    F.sum(F.octet_length("code")).cast("long").alias("code_bytes"))


NEAREST_LISTS = "row_number() OVER (PARTITION BY vec_id ORDER BY away, label) AS place"


@query("f4_nearest_in_lists", f"""
  WITH long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
  centre AS (SELECT label, pos, avg(x) AS c FROM long GROUP BY ALL),
  size AS (SELECT vec_id, sqrt(sum(x * x)) AS size FROM long GROUP BY 1),
  far AS (SELECT vec_id, c.label, sum(c * c) - 2 * sum(x * c) / any_value(size) AS away FROM long JOIN centre c USING (pos) JOIN size USING (vec_id) GROUP BY ALL),
  placed AS (SELECT vec_id, label, {NEAREST_LISTS} FROM far)
  SELECT query_id, chunk_id, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dense_score
    FROM placed q JOIN placed v ON q.label = v.label AND v.place = 1 AND q.place <= 3 AND q.vec_id % 50 = 0
    JOIN embeddings a ON a.vec_id = q.vec_id JOIN embeddings b ON b.vec_id = v.vec_id) QUALIFY rank <= 20""")
def f4d(spark, sf):
    """Search in the lists of given centroids, the mean vector of each label (one row per label reaches the driver)."""
    vectors, _ = vectors_and_queries(spark, sf)
    long = t(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("c"))
    means = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda p: p["c"]).alias("c")).orderBy("label").collect()
    return ranked_long(vi.listed_top_k(vectors, fiftieth(spark, sf), np.array([r["c"] for r in means]), 3))


@query("f5_encoded_chunks", sql("chunk_buckets", "chunk_norms", body="""
  SELECT chunk_id, count(*) AS n_buckets, round(sum(w / size), 6) AS weight_sum, round(max(w / size), 6) AS largest
  FROM chunk_buckets JOIN chunk_norms USING (chunk_id) GROUP BY 1"""))
def f5(spark, sf):
    rows = ix.with_vectors(chunks(spark, sf)).select("chunk_id", vx.l2_normalise(F.col("embedding")).alias("v"))
    return rows.select("chunk_id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_buckets"),
                       F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("weight_sum"),
                       F.round(F.array_max("v"), 6).alias("largest"))


# --- access ------------------------------------------------------------------------

@query("g2_live_grants", sql("live", body="SELECT * FROM live"))
def g2(spark, sf):
    return ac.live_grants(s.grants(spark, sf), s.GRANTS_AS_OF)


@query("g1_visible_documents", sql("docs", "people", "live", body="""
  , cells AS (SELECT dept_id, folder_id, count(*) AS n FROM docs WHERE status = 'indexed' GROUP BY ALL),
  seen AS (SELECT p.user_id, c.n, c.dept_id = p.dept_id AS own, l.folder_id IS NOT NULL AS granted
           FROM people p CROSS JOIN cells c LEFT JOIN live l ON l.user_id = p.user_id AND l.folder_id = c.folder_id)
  SELECT user_id, coalesce(sum(n) FILTER (own), 0)::BIGINT AS dept_docs, coalesce(sum(n) FILTER (granted), 0)::BIGINT AS folder_docs,
         coalesce(sum(n) FILTER (own OR granted), 0)::BIGINT AS all_docs FROM seen GROUP BY 1""".replace("\n  , cells", ", cells", 1)))
def g1(spark, sf):
    return ac.visible_counts(s.people(spark, sf), ac.live_grants(s.grants(spark, sf), s.GRANTS_AS_OF), s.docs(spark, sf))


# --- the three searches ---------------------------------------------------------------

INDEXES = {}


def index(spark, sf):
    """The search index of the documents: written once per session and folder, then read by every search."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in INDEXES:
        INDEXES[key] = hy.SearchIndex.of_documents(s.docs(spark, sf))
    return INDEXES[key]


def queries(spark, sf, access=False):
    rows = s.asked(spark, sf)
    if access:
        rows = ac.with_folders(rows.join(s.people(spark, sf), "user_id"), ac.live_grants(s.grants(spark, sf), s.GRANTS_AS_OF))
    return rows


def top(score: str, k: int = 20) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) <= {k}"


RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) AS rank"
part("ready", "SELECT chunk_id, c.doc_id, chunk_idx, content, token_cnt, dept_id, folder_id FROM chunks c JOIN docs d ON d.doc_id = c.doc_id WHERE status = 'indexed'",
     "chunks", "docs")
part("scored", """
  SELECT query_id, chunk_id, round(sum(q.w * c.w) / (any_value(qn.size) * any_value(cn.size)), 6) AS dense_score
  FROM query_buckets q JOIN chunk_buckets c USING (bucket) JOIN query_norms qn USING (query_id) JOIN chunk_norms cn USING (chunk_id)
  WHERE chunk_id IN (SELECT chunk_id FROM ready) GROUP BY query_id, chunk_id""", "query_buckets", "chunk_buckets", "query_norms", "chunk_norms", "ready")
part("dense", f"SELECT *, {RANK.format(score='dense_score')} FROM scored {top('dense_score')}", "scored")

part("forms", f"""
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, variant, variant_norm FROM (
    SELECT query_id, pos, variant, {s.sql_norm('variant')} AS variant_norm FROM (
      SELECT query_id, pos, term AS variant FROM ({s.sql_terms('asked', 'query_id', 'query_text')})
      UNION ALL SELECT query_id, 1000000, query_text FROM asked) WHERE {s.sql_norm('variant')} <> ''
    QUALIFY row_number() OVER (PARTITION BY query_id, variant_norm ORDER BY pos) = 1)""", "asked")
part("query_words", f"SELECT DISTINCT query_id, unnest({s.sql_index_tokens('variant')}) AS word FROM forms", "forms")
part("ready_tokens", f"SELECT chunk_id, unnest({s.sql_index_tokens('content')}) AS word FROM ready", "ready")
part("ready_sizes", f"SELECT chunk_id, len({s.sql_index_tokens('content')}) AS n FROM ready", "ready")
part("ready_tf", "SELECT chunk_id, word, count(*)::DOUBLE AS tf FROM ready_tokens WHERE word IN (SELECT word FROM query_words) GROUP BY ALL",
     "ready_tokens", "query_words")
part("bm25", """
  SELECT query_id, t.chunk_id, word, ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS s
  FROM query_words q JOIN ready_tf t USING (word) JOIN ready_sizes z ON z.chunk_id = t.chunk_id
  JOIN (SELECT word, count(*) AS df FROM ready_tf GROUP BY 1) d USING (word)
  CROSS JOIN (SELECT count(*) AS total, avg(n) AS mean FROM ready_sizes) g""", "ready_tf", "ready_sizes", "query_words")
part("all_scores", """
  SELECT query_id, chunk_id, sparse_score FROM (SELECT query_id, chunk_id, round(sum(s), 6) AS sparse_score, count(*) AS n FROM bm25 GROUP BY ALL)
  JOIN (SELECT query_id, count(*) AS n FROM query_words GROUP BY 1) USING (query_id, n)""", "bm25", "query_words")
part("any_scores", "SELECT query_id, chunk_id, round(sum(s), 6) AS sparse_score FROM bm25 GROUP BY ALL", "bm25")
part("sparse", f"SELECT *, {RANK.format(score='sparse_score')} FROM all_scores {top('sparse_score')}", "all_scores")

part("ready_normal", f"SELECT chunk_id, {s.sql_norm('content')} AS normal FROM ready", "ready")
part("ready_keywords", sql_keywords("ready", "chunk_id", "content", "ranked_builtin").replace("normal JOIN", "ready_normal JOIN"),
     "ready", "ready_normal", "ranked_builtin")
part("keyword_scores", """
  SELECT query_id, chunk_id, round(sum(weight), 6) AS keyword_score FROM forms JOIN ready_keywords ON normalized_keyword = variant_norm
  WHERE length(variant_norm) >= 2 GROUP BY ALL""", "forms", "ready_keywords")
part("keyword", f"SELECT *, {RANK.format(score='keyword_score')} FROM keyword_scores {top('keyword_score')}", "keyword_scores")


def ranked_long(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


@query("g3_dense_top_k", sql("dense", body="SELECT query_id, chunk_id, dense_score, rank FROM dense"))
def g3a(spark, sf):
    asked = queries(spark, sf).withColumn("query_vector", vx.hash_embedding(F.col("query_text")))
    return ranked_long(nn.dense_top_k(index(spark, sf).vectors, asked, fv.VECTOR_DIM))


@query("g3_dense_self_search", """
  SELECT query_id, chunk_id, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dense_score
    FROM embeddings a, embeddings b) QUALIFY rank <= 20""")
def g3b(spark, sf):
    vectors, asked = vectors_and_queries(spark, sf)
    return ranked_long(nn.dense_top_k(vectors, asked, 64))


# access in SQL, for any scored pair of query and chunk
part("allowed", """
  SELECT a.query_id, r.chunk_id FROM asked a JOIN people p ON p.user_id = a.user_id CROSS JOIN ready r
  LEFT JOIN live l ON l.user_id = a.user_id AND l.folder_id = r.folder_id
  WHERE CASE search_scope WHEN 'dept' THEN r.dept_id = p.dept_id WHEN 'folder' THEN l.folder_id IS NOT NULL
        ELSE r.dept_id = p.dept_id OR l.folder_id IS NOT NULL END""", "asked", "people", "ready", "live")


def guarded(scores: str, score: str) -> str:
    return f"SELECT s.*, {RANK.format(score=score)} FROM {scores} s SEMI JOIN allowed USING (query_id, chunk_id) {top(score)}"


@query("g3_dense_under_access", sql("scored", "allowed", body=guarded("scored", "dense_score")))
def g3c(spark, sf):
    asked = queries(spark, sf, True).withColumn("query_vector", vx.hash_embedding(F.col("query_text")))
    found = index(spark, sf)
    vectors = found.vectors.select("chunk_id", "embedding", "dept_id", "folder_id")
    return ranked_long(nn.dense_top_k(vectors, asked, fv.VECTOR_DIM, access=True))


def expanded(spark, sf):
    return ix.settled(rt.expanded_queries(s.asked(spark, sf), tm.alias_rows(spark)))


@query("g4_sparse_top_k", sql("sparse", body="SELECT * FROM sparse"))
def g4a(spark, sf):
    return ranked_long(rt.sparse_top_k(index(spark, sf).words, queries(spark, sf), rt.search_words(expanded(spark, sf))))


@query("g4_sparse_any_word", sql("any_scores", body=f"SELECT *, {RANK.format(score='sparse_score')} FROM any_scores {top('sparse_score')}"))
def g4b(spark, sf):
    return ranked_long(rt.sparse_top_k(index(spark, sf).words, queries(spark, sf), rt.search_words(expanded(spark, sf)), match="any"))


@query("g4_sparse_under_access", sql("all_scores", "allowed", body=guarded("all_scores", "sparse_score")))
def g4c(spark, sf):
    return ranked_long(rt.sparse_top_k(index(spark, sf).words, queries(spark, sf, True), rt.search_words(expanded(spark, sf)), access=True))


@query("g5_keyword_top_k", sql("keyword", body="SELECT * FROM keyword"))
def g5a(spark, sf):
    return ranked_long(rt.keyword_top_k(index(spark, sf).keywords, queries(spark, sf), expanded(spark, sf)))


@query("g5_keyword_under_access", sql("keyword_scores", "allowed", body=guarded("keyword_scores", "keyword_score")))
def g5b(spark, sf):
    return ranked_long(rt.keyword_top_k(index(spark, sf).keywords, queries(spark, sf, True), expanded(spark, sf), access=True))


# --- fusion, boost -----------------------------------------------------------------------

FUSED = """
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first_seen) AS fused_rank FROM (
    SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 10) AS rrf_score, min(branch * 1000 + rank) AS first_seen,
           max(score) FILTER (branch = 0) AS dense_score, max(score) FILTER (branch = 1) AS sparse_score,
           max(score) FILTER (branch = 2) AS keyword_score FROM (
      SELECT query_id, chunk_id, 0 AS branch, rank, dense_score AS score FROM {0}
      UNION ALL SELECT query_id, chunk_id, 1, rank, sparse_score FROM {1}
      UNION ALL SELECT query_id, chunk_id, 2, rank, keyword_score FROM {2}) GROUP BY query_id, chunk_id)"""
part("fused", FUSED.format("dense", "sparse", "keyword"), "dense", "sparse", "keyword")


@query("g7_rank_fusion", sql("fused", body="SELECT * EXCLUDE (first_seen) FROM fused"))
def g7(spark, sf):
    found, asked, forms = index(spark, sf), queries(spark, sf), expanded(spark, sf)
    with_vector = asked.withColumn("query_vector", vx.hash_embedding(F.col("query_text")))
    rows = rt.fuse_ranks({
        "dense": nn.dense_top_k(found.vectors, with_vector, fv.VECTOR_DIM),
        "sparse": rt.sparse_top_k(found.words, asked, rt.search_words(forms)),
        "keyword": rt.keyword_top_k(found.keywords, asked, forms)})
    return rows.withColumn("fused_rank", F.col("fused_rank").cast("long"))


def sql_any(hints, text):
    return "(" + " OR ".join(f"contains({text}, '{h}')" for h in hints) + ")"


def sql_preferences(text: str) -> dict[str, str]:
    return {kind: "greatest(" + ", ".join(f"CASE WHEN {sql_any(h, text)} THEN {v} ELSE 0 END" for h, v in rules) + ", 0)::DOUBLE"
            for kind, rules in fv.BLOCK_PREFERENCES.items()}


PREFS = sql_preferences("hints")


@query("g8_block_preferences", f"""
  SELECT conv_id, turn, {', '.join(f'{v} AS pref_{k}' for k, v in PREFS.items())}
  FROM (SELECT conv_id, turn, {s.sql_norm('text')} AS hints FROM conversations)""")
def g8(spark, sf):
    prefs = rt.block_preferences(F.col("hints"))
    rows = t(spark, sf, "conversations").select("conv_id", "turn", tx.normalise(F.col("text")).alias("hints"))
    return rows.select("conv_id", "turn", *[v.alias(f"pref_{k}") for k, v in prefs.items()])


part("query_profile", f"""
  SELECT query_id, query_norm, forms, {', '.join(f'{v} AS pref_{k}' for k, v in PREFS.items())} FROM (
    SELECT a.query_id, {s.sql_norm('any_value(query_text)')} AS query_norm,
           list(variant_norm) FILTER (length(variant_norm) >= 2) AS forms,
           {s.sql_norm("any_value(query_text) || ' ' || string_agg(variant, ' ' ORDER BY pos)")} AS hints
    FROM asked a LEFT JOIN forms f ON f.query_id = a.query_id GROUP BY a.query_id)""", "asked", "forms")


def sql_boosted(hits: str) -> str:
    """Hits with doc, chunk and block fields to boosted hits."""
    return f"""
  SELECT * EXCLUDE (boost, hay, name_norm), round(boost, 4) AS exact_match_boost, rrf_score + boost AS final_score FROM (
    SELECT *, (CASE WHEN query_norm <> '' AND contains(hay, query_norm) THEN 0.35 ELSE 0 END
      + CASE WHEN query_norm <> '' AND contains(name_norm, query_norm) THEN 0.2 ELSE 0 END
      + least(len(list_filter(forms, lambda f: contains(hay, f))) * 0.06, 0.3)
      + least(coalesce(keyword_score, 0) * 0.05, 0.25)
      + CASE block_type WHEN 'table' THEN pref_table WHEN 'image' THEN pref_image WHEN 'caption' THEN pref_caption WHEN 'text' THEN pref_text ELSE 0 END
      + CASE WHEN block_type = 'table' AND contains(content, '|') THEN 0.04 ELSE 0 END
      + CASE WHEN block_type = 'caption' AND coalesce(page_number, 0) <> 0 THEN 0.03 ELSE 0 END
      + CASE WHEN coalesce(sheet_name, '') <> '' AND contains(hay, 'sheet') THEN 0.03 ELSE 0 END
      + CASE WHEN coalesce(slide_number, 0) <> 0 AND (contains(query_norm, 'slide') OR contains(query_norm, '슬라이드')) THEN 0.03 ELSE 0 END)::DOUBLE AS boost FROM (
      SELECT *, {s.sql_norm("concat_ws(' ', file_name, nullif(content, ''), section_path, sheet_name, slide_number, page_number, block_type, file_type)")} AS hay,
             {s.sql_norm('file_name')} AS name_norm FROM {hits}))"""


part("hits", """
  SELECT f.*, r.doc_id, r.content, d.file_name, d.type AS file_type, 'text' AS block_type, NULL::VARCHAR AS section_path,
         NULL::VARCHAR AS sheet_name, NULL::BIGINT AS slide_number, NULL::BIGINT AS page_number,
         q.query_norm, q.forms, q.pref_text, q.pref_table, q.pref_image, q.pref_caption, a.query_text, a.user_id
  FROM fused f JOIN ready r USING (chunk_id) JOIN docs d ON d.doc_id = r.doc_id JOIN query_profile q USING (query_id) JOIN asked a USING (query_id)""",
     "fused", "ready", "docs", "query_profile", "asked")
part("boosted", sql_boosted("hits"), "hits")
BOOSTED = "query_id, chunk_id, doc_id, file_name, dense_score, sparse_score, keyword_score, rrf_score, exact_match_boost, round(final_score, 6) AS final_score"


def boosted_columns(rows):
    return rows.select("query_id", "chunk_id", "doc_id", "file_name", "dense_score", "sparse_score", "keyword_score", "rrf_score",
                       "exact_match_boost", F.round("final_score", 6).alias("final_score"))


@query("g10_hybrid_search", sql("boosted", body=f"SELECT {BOOSTED} FROM boosted"))
def g10a(spark, sf):
    return boosted_columns(hy.hybrid_search(index(spark, sf), queries(spark, sf)))


part("dense_seen", guarded("scored", "dense_score"), "scored", "allowed")
part("sparse_seen", guarded("all_scores", "sparse_score"), "all_scores", "allowed")
part("keyword_seen", guarded("keyword_scores", "keyword_score"), "keyword_scores", "allowed")
part("fused_seen", FUSED.format("dense_seen", "sparse_seen", "keyword_seen"), "dense_seen", "sparse_seen", "keyword_seen")
part("hits_seen", """
  SELECT f.*, r.doc_id, r.content, d.file_name, d.type AS file_type, 'text' AS block_type, NULL::VARCHAR AS section_path,
         NULL::VARCHAR AS sheet_name, NULL::BIGINT AS slide_number, NULL::BIGINT AS page_number, q.query_norm, q.forms,
         q.pref_text, q.pref_table, q.pref_image, q.pref_caption
  FROM fused_seen f JOIN ready r USING (chunk_id) JOIN docs d ON d.doc_id = r.doc_id JOIN query_profile q USING (query_id)""",
     "fused_seen", "ready", "docs", "query_profile")
part("boosted_seen", sql_boosted("hits_seen"), "hits_seen")


@query("g10_hybrid_search_under_access", sql("boosted_seen", body=f"SELECT {BOOSTED} FROM boosted_seen"))
def g10b(spark, sf):
    return boosted_columns(hy.hybrid_search(index(spark, sf), queries(spark, sf, True), access=True))


# --- hits over blocks ---------------------------------------------------------------------

part("block_chunks", "SELECT doc_id * 16777216 + chunk_idx AS chunk_id, * FROM line_chunks_full", "line_chunks_full")
part("line_chunks_full", """
  SELECT l.*, b.block_idx FROM line_chunks l JOIN blocks_by_line b ON b.doc_id = l.doc_id AND b.page_number = l.page_number""",
     "line_chunks", "blocks_by_line")
part("block_keywords", sql_keywords("block_chunks", "chunk_id", "content", "ranked_builtin").replace("normal JOIN", "block_normal JOIN"),
     "block_chunks", "block_normal", "ranked_builtin")
part("block_normal", f"SELECT chunk_id, {s.sql_norm('content')} AS normal FROM block_chunks", "block_chunks")
KIND = {"en": "table", "fr": "caption", "de": "image", "es": "text"}
part("block_hits", f"""
  SELECT query_id, chunk_id, keyword_score, 1 / (60 + {RANK.format(score='keyword_score').replace(' AS rank', '')}) AS rrf_score,
         doc_id, content, file_name, file_type, block_type, page_number, NULL::VARCHAR AS sheet_name, NULL::BIGINT AS slide_number,
         NULL::VARCHAR AS section_path, query_norm, forms, pref_text, pref_table, pref_image, pref_caption FROM (
    SELECT k.*, c.doc_id, c.content, d.file_name, d.type AS file_type,
           CASE WHEN c.chunk_type = 'es' THEN c.chunk_type ELSE {s.sql_cases('c.chunk_type', KIND)} END AS block_type, c.page_number, q.* EXCLUDE (query_id)
    FROM (SELECT * FROM (SELECT query_id, chunk_id, round(sum(weight), 6) AS keyword_score FROM forms JOIN block_keywords ON normalized_keyword = variant_norm
          WHERE length(variant_norm) >= 2 GROUP BY query_id, chunk_id) {top('keyword_score')}) k
    JOIN block_chunks c USING (chunk_id) JOIN docs d ON d.doc_id = c.doc_id JOIN query_profile q USING (query_id))""",
     "forms", "block_keywords", "block_chunks", "docs", "query_profile")


def block_index(spark, sf):
    blocks = page_line_blocks(spark, sf)
    chunks_ = ix.settled(ix.block_chunk_table(blocks, size=40, overlap=8))
    stored = blocks.filter("block_type <> 'es'").withColumn("block_type", s.cases("block_type", KIND))
    for name, kind in (("sheet_name", "string"), ("slide_number", "int"), ("section_path", "string")):
        stored = stored.withColumn(name, F.lit(None).cast(kind))
    return chunks_, stored


def block_hits(spark, sf):
    """Keyword hits over block chunks; Spanish documents have chunks but no stored blocks."""
    chunks_, stored = block_index(spark, sf)
    asked, forms = queries(spark, sf), expanded(spark, sf)
    hits = rt.keyword_top_k(ix.keyword_lists(chunks_), asked, forms)
    hits = hits.withColumn("rrf_score", 1 / (F.lit(60.0) + F.col("rank"))).withColumnRenamed("rank", "fused_rank")
    rows = rt.hit_rows(hits, chunks_, s.docs(spark, sf), stored)
    return rows.join(rt.with_query_profile(asked, forms), "query_id")


@query("g6_hit_rows", sql("block_hits", body="SELECT query_id, chunk_id, doc_id, keyword_score, content, block_type, page_number, file_name, file_type FROM block_hits"))
def g6(spark, sf):
    rows = block_hits(spark, sf)
    return rows.select("query_id", "chunk_id", "doc_id", "keyword_score", "content", "block_type", F.col("page_number").cast("long").alias("page_number"),
                       "file_name", "file_type")


part("block_boosted", sql_boosted("block_hits"), "block_hits")


@query("g9_exact_match_boost", sql("block_boosted", body="SELECT query_id, chunk_id, block_type, exact_match_boost, round(final_score, 6) AS final_score FROM block_boosted"))
def g9(spark, sf):
    rows = rt.exact_match_boost(block_hits(spark, sf))
    return rows.select("query_id", "chunk_id", "block_type", "exact_match_boost", F.round("final_score", 6).alias("final_score"))
