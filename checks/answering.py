"""Reranking, context and log rows (G11 to G18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.graphs import graph_texts
from checks.registry import part, query, sql
from checks.searching import block_hits, index, queries
from checks.standins import t
from leafmill.functions import fixed_values as fv
from leafmill.operators import answers as an
from leafmill.plans import hybrid as hy

HEADER = """'[' || concat_ws(' | ', 'type=' || coalesce(nullif(block_type, ''), 'text'), CASE WHEN coalesce(page_number, 0) <> 0 THEN 'page=' || page_number END,
  CASE WHEN sheet_name <> '' THEN 'sheet=' || sheet_name END, CASE WHEN coalesce(slide_number, 0) <> 0 THEN 'slide=' || slide_number END,
  CASE WHEN section_path <> '' THEN 'section=' || section_path END) || ']' || chr(10) || substr(content, 1, 512)"""


@query("g11_rerank_texts", sql("block_hits", body=f"SELECT query_id, chunk_id, {HEADER} AS rerank_text FROM block_hits"))
def g11(spark, sf):
    return block_hits(spark, sf).select("query_id", "chunk_id", an.rerank_text().alias("rerank_text"))


Q_WORDS, C_WORDS = s.sql_words("lower(query_text)"), s.sql_words(f"lower({HEADER})")
part("reranked", f"""
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, round(final_score, 9) DESC, fused_rank) AS place FROM (
    SELECT *, round(len(list_intersect(list_distinct({Q_WORDS}), list_distinct({C_WORDS}))) / greatest(len(list_distinct({Q_WORDS})), 1)
      + CASE WHEN query_text <> '' AND contains(lower({HEADER}), lower(query_text)) THEN 0.5 ELSE 0 END, 6) AS rerank_score FROM boosted)
  QUALIFY place <= 5""", "boosted")


def boosted(spark, sf):
    return hy.hybrid_search(index(spark, sf), queries(spark, sf))


def reranked(spark, sf):
    return an.rerank(boosted(spark, sf))


@query("g12_rerank", sql("reranked", body="SELECT query_id, place, chunk_id, rerank_score FROM reranked"))
def g12(spark, sf):
    return reranked(spark, sf).select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", "rerank_score")


@query("g13_reference_rows", sql("reranked", body="""
  SELECT query_id, place, doc_id, chunk_id, file_name, page_number AS page, sheet_name, slide_number, section_path, block_type,
         round(rerank_score, 3) AS score FROM reranked"""))
def g13(spark, sf):
    rows = an.reference_rows(reranked(spark, sf))
    for c in ("place", "page", "slide_number"):
        rows = rows.withColumn(c, F.col(c).cast("long"))
    return rows


PROMPT = "Answer from the documents."
part("context", f"""
  SELECT query_id, concat_ws(chr(10) || chr(10), '{PROMPT}', graph_text, '{fv.CONTEXT_OPEN.strip()}' || chr(10) || docs || chr(10) || '{fv.CONTEXT_CLOSE.strip()}',
         CASE WHEN docs IS NOT NULL THEN '{fv.CONTEXT_NOTE}' END) AS system_text
  FROM (SELECT query_id, string_agg('[{fv.DOCUMENT_WORD} ' || place || ': ' || file_name || ' type=' || block_type || ']' || chr(10) || substr(content, 1, 500),
               chr(10) || chr(10) ORDER BY place) AS docs FROM reranked GROUP BY query_id)
  FULL JOIN graph_texts USING (query_id)""", "reranked", "graph_texts")


def context(spark, sf):
    return an.context_texts(reranked(spark, sf), PROMPT, graph_texts(spark, sf))


@query("g14_context", sql("context", body="SELECT * FROM context"))
def g14(spark, sf):
    return context(spark, sf)


def messages(spark, sf):
    return t(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", "text")


@query("g15_session_history", """
  SELECT conv_id AS session_id, turn AS created_at, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (
    SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)""")
def g15(spark, sf):
    return an.session_history(messages(spark, sf), 4).withColumn("place", F.col("place").cast("long"))


@query("g16_session_list", """
  SELECT conv_id AS session_id, max(turn) AS updated_at, count(*) AS message_count FROM conversations GROUP BY 1
  ORDER BY updated_at DESC, session_id DESC LIMIT 20 OFFSET 10""")
def g16(spark, sf):
    rows = messages(spark, sf)
    sessions = rows.groupBy("session_id").agg(F.max("created_at").alias("updated_at"))
    return an.session_list(sessions, rows, [F.desc("updated_at"), F.desc("session_id")], 20, 10)


@query("g17_input_tokens", sql("context", body="""
  SELECT query_id, (length(to_json([{'role': 'system', 'content': system_text}, {'role': 'user', 'content': query_text}])::VARCHAR) + 7) // 4 AS input_tokens
  FROM context JOIN asked USING (query_id)"""))
def g17a(spark, sf):
    rows = an.chat_messages(context(spark, sf), queries(spark, sf))
    return rows.select("query_id", an.input_tokens(F.col("messages")).alias("input_tokens"))


@query("g17_session_titles", """
  SELECT conv_id AS session_id, CASE WHEN role = 'system' THEN 'System' ELSE substr(text, 1, 50) END AS title FROM conversations WHERE turn = 0""")
def g17b(spark, sf):
    first = messages(spark, sf).filter("created_at = 0")
    sessions = first.select("session_id", F.when(F.col("role") == "system", "System").alias("title"))
    return an.session_titles(sessions, first.select("session_id", F.col("text").alias("message")))


@query("g18_query_log_rows", sql("boosted", "reranked", body="""
  SELECT a.query_id, a.user_id, a.query_text AS prompt, retrieved_chunks, reranked_chunks FROM asked a
  LEFT JOIN (SELECT query_id, to_json(list({'chunk_id': chunk_id, 'block_type': block_type, 'rrf_score': round(rrf_score, 4)} ORDER BY r))::VARCHAR AS retrieved_chunks FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, fused_rank) AS r FROM boosted QUALIFY r <= 10) GROUP BY 1) x ON x.query_id = a.query_id
  LEFT JOIN (SELECT query_id, to_json(list({'chunk_id': chunk_id, 'block_type': block_type, 'rerank_score': round(rerank_score, 4)} ORDER BY place))::VARCHAR AS reranked_chunks
    FROM reranked GROUP BY 1) y ON y.query_id = a.query_id"""))
def g18(spark, sf):
    from leafmill.plans.indexing import settled
    hits = settled(boosted(spark, sf))
    return an.query_log_rows(queries(spark, sf), hits, an.rerank(hits))
