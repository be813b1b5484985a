"""Reranking, references, context and log rows for answered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as fv
from leafmill.functions import text as tx
from leafmill.functions.ordered import top_k

Q, C = "query_id", "chunk_id"


def _labelled(label: str, column: str) -> Column:
    """`label=value`, or null where the value is missing, empty or 0."""
    value = F.col(column).cast("string")
    return F.when((value != "") & (value != "0"), F.concat(F.lit(f"{label}="), value))


def _kind() -> Column:
    return F.coalesce(F.nullif(F.col("block_type"), F.lit("")), F.lit("text"))


def rerank_text() -> Column:
    """A header of block type and place, then the first 512 characters."""
    header = F.concat_ws(" | ", F.concat(F.lit("type="), _kind()), _labelled("page", "page_number"),
                         _labelled("sheet", "sheet_name"), _labelled("slide", "slide_number"),
                         _labelled("section", "section_path"))
    return F.concat(F.lit("["), header, F.lit("]\n"), F.substring("content", 1, 512))


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's words found in the content, +0.5 if it holds the query."""
    asked = F.array_distinct(tx.words(F.lower(query)))
    given = tx.words(F.lower(content))
    share = F.size(F.array_intersect(asked, given)) / F.greatest(F.size(asked), F.lit(1))
    whole = (query != "") & F.contains(F.lower(content), F.lower(query))
    return share + F.when(whole, 0.5).otherwise(0.0)


def rerank(hits: DataFrame, k: int = fv.RERANK_LIMIT) -> DataFrame:
    """The k best hits of each query by overlap; ties keep the boosted order."""
    scored = hits.withColumn("rerank_score", F.round(overlap_score(F.col("query_text"), rerank_text()), 6))
    order = [F.desc("rerank_score"), F.desc(F.round("final_score", 9)), F.asc("fused_rank")]
    return top_k(scored, [Q], order, k, rank="place")


def reference_rows(reranked: DataFrame) -> DataFrame:
    block = [c for c in ("block_idx",) if c in reranked.columns]
    return reranked.select(
        Q, "place", "doc_id", C, *block, "file_name", F.col("page_number").alias("page"), "sheet_name",
        "slide_number", "section_path", "block_type", F.round("rerank_score", 3).alias("score"))


def context_texts(reranked: DataFrame, system_prompt: str, graph: DataFrame | None = None,
                  web: DataFrame | None = None) -> DataFrame:
    """The system message of each query: prompt, graph text, documents, web results.

    A query has at most the reranked number of chunks, so its rows fit one group.
    `graph` is (query_id, graph_text); `web` is (query_id, place, title, url, snippet).
    """
    spaced = lambda label, col: F.coalesce(F.concat(F.lit(" "), _labelled(label, col)), F.lit(""))
    page = F.regexp_replace(spaced("p", "page_number"), "=", ".")
    header = F.concat(F.lit(f"[{fv.DOCUMENT_WORD} "), F.col("place").cast("string"), F.lit(": "), F.col("file_name"), page,
                      spaced("sheet", "sheet_name"), spaced("slide", "slide_number"), F.lit(" type="), _kind(),
                      spaced("section", "section_path"), F.lit("]\n"), F.substring("content", 1, 500))
    docs = reranked.select(Q, "place", header.alias("part")).groupBy(Q).agg(_joined("place", "part").alias("docs"))
    rows = docs
    if graph is not None:
        rows = rows.join(graph.select(Q, "graph_text"), Q, "full")
    else:
        rows = rows.withColumn("graph_text", F.lit(None).cast("string"))
    if web is not None:
        part = F.concat(F.lit(f"[{fv.WEB_WORD} "), F.col("place").cast("string"), F.lit(": "), F.col("title"),
                        F.lit("]\nURL: "), F.col("url"), F.lit("\n"), F.col("snippet"))
        rows = rows.join(web.select(Q, "place", part.alias("part")).groupBy(Q).agg(_joined("place", "part").alias("web")), Q, "full")
    else:
        rows = rows.withColumn("web", F.lit(None).cast("string"))
    has = lambda c, open_, close: F.concat(F.lit(open_), F.col(c), F.lit(close))
    return rows.select(Q, F.concat_ws(
        "\n\n", F.lit(system_prompt), F.nullif("graph_text", F.lit("")),
        has("docs", fv.CONTEXT_OPEN, fv.CONTEXT_CLOSE), F.when(F.col("docs").isNotNull(), fv.CONTEXT_NOTE),
        has("web", fv.WEB_OPEN, fv.WEB_CLOSE), F.when(F.col("web").isNotNull(), fv.WEB_NOTE)).alias("system_text"))


def _joined(place: str, part: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(place, part)))
    return F.array_join(F.transform(ordered, lambda x: x[part]), "\n\n")


def session_history(messages: DataFrame, keep: int = 20) -> DataFrame:
    """The latest `keep` messages of each session, numbered in time order."""
    last = top_k(messages, ["session_id"], [F.desc("created_at")], keep, rank="_back")
    from pyspark.sql import Window
    size = F.max("_back").over(Window.partitionBy("session_id"))
    return last.withColumn("place", size - F.col("_back") + 1).drop("_back")


def session_list(sessions: DataFrame, messages: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of sessions with their message counts; counts are made before the join."""
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
    page = sessions.orderBy(*order).offset(offset).limit(limit)
    return page.join(counts, "session_id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)).cast("long"))


def chat_messages(context: DataFrame, queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(query_id, messages): system text, earlier messages, then the question.

    `history` is (query_id, place, role, content), at most 20 rows per query.
    """
    message = "array<struct<role:string,content:string>>"
    say = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))).cast(message)
    rows = context.join(queries.select(Q, "query_text"), Q)
    if history is not None:
        told = history.groupBy(Q).agg(F.sort_array(F.collect_list(F.struct("place", "role", "content"))).alias("_h"))
        rows = rows.join(told, Q, "left")
        past = F.coalesce(F.transform("_h", lambda h: F.struct(h["role"], h["content"])).cast(message),
                          F.array().cast(message))
    else:
        past = F.array().cast(message)
    return rows.select(Q, F.concat(say("system", "system_text"), past, say("user", "query_text")).alias("messages"))


def input_tokens(messages: Column) -> Column:
    """A quarter of the length of the messages as JSON with a space after each , and :"""
    n = F.size(messages)
    return F.floor((F.length(F.to_json(messages)) + 3 * n + n - 1) / 4).cast("long")


def session_titles(sessions: DataFrame, first_messages: DataFrame) -> DataFrame:
    """Sessions without a title take the first 50 characters of a message."""
    named = F.coalesce(F.nullif("title", F.lit("")), F.substring("message", 1, 50))
    return sessions.join(first_messages.select("session_id", "message"), "session_id", "left").withColumn(
        "title", named).drop("message")


def query_log_rows(queries: DataFrame, boosted: DataFrame, reranked: DataFrame) -> DataFrame:
    """One log row per query: the top 10 retrieved and the reranked list as JSON."""
    def packed(rows, place, score, out, digits=4):
        item = F.struct(F.col(place).alias("_place"), F.col(C).alias("chunk_id"), "block_type",
                        F.round(score, digits).alias(score))
        listed = F.sort_array(F.collect_list(item))
        bare = F.transform(listed, lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["block_type"].alias("block_type"),
                                                      x[score].alias(score)))
        return rows.groupBy(Q).agg(F.to_json(bare).alias(out))

    best = top_k(boosted, [Q], [F.desc(F.round("final_score", 9)), F.asc("fused_rank")], 10, rank="_rank")
    return (queries.select(Q, "user_id", F.col("query_text").alias("prompt"))
            .join(packed(best, "_rank", "rrf_score", "retrieved_chunks"), Q, "left")
            .join(packed(reranked, "place", "rerank_score", "reranked_chunks"), Q, "left"))
