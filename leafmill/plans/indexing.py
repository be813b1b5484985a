"""From documents to the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import vectors as vx
from leafmill.operators import chunks as ck
from leafmill.operators import graph as gr
from leafmill.operators import terms as tm
from leafmill.operators.retrieval import chunk_key
from leafmill.session import cut_lineage
from leafmill.sources.tables import write_by_document


def text_chunk_table(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = (), **params) -> DataFrame:
    """chunk_id, doc_id, chunk_idx, content, token_cnt, chunk_type of documents with plain text.

    `carry` names document columns every chunk keeps, so that no join has to bring them back.
    """
    rows = ck.chunk_texts(docs, ["doc_id", *carry], text_col, **params)
    return rows.select(chunk_key(F.col("doc_id"), F.col("chunk_idx")).alias("chunk_id"), "doc_id",
                       F.col("chunk_idx").cast("long").alias("chunk_idx"), "content", "token_cnt",
                       F.lit("text").alias("chunk_type"), *carry)


def block_chunk_table(blocks: DataFrame, **params) -> DataFrame:
    rows = ck.chunk_blocks(blocks, **params)
    return rows.withColumn("chunk_id", chunk_key(F.col("doc_id"), F.col("chunk_idx")))


def with_vectors(chunks: DataFrame) -> DataFrame:
    """Chunks with their count vectors; cosine does not depend on a vector's length."""
    return chunks.withColumn("embedding", vx.hash_embedding(F.col("content")))


def _keyword_keys(chunks: DataFrame) -> list[str]:
    return [c for c in ("chunk_id", "doc_id", "dept_id", "folder_id") if c in chunks.columns]


def keyword_table(chunks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    return tm.keyword_index(chunks, _keyword_keys(chunks), "content", aliases)


def keyword_lists(chunks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The keyword table with a row per chunk, as searches read it."""
    return tm.keyword_lists(chunks, _keyword_keys(chunks), "content", aliases)


def posting_table(chunks: DataFrame) -> DataFrame:
    return tm.postings(chunks, ["chunk_id"], "content")


def mention_table(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """Mentions of whole documents, read from their chunks joined in order.

    A document's chunks are an array in its own row here, so joining them
    needs no shuffle.
    """
    cut = ck.chunk_lists(docs, ["doc_id"], text_col, **params)
    return gr.mentions(cut.select("doc_id", F.array_join("pieces", " ").alias("text")))


SEARCHED = ["chunks", "vectors", "keywords", "postings", "terms", "totals"]


def vector_table(chunks: DataFrame) -> DataFrame:
    rights = [c for c in ("dept_id", "folder_id") if c in chunks.columns]
    return with_vectors(chunks).select("chunk_id", "doc_id", *rights, "embedding")


def search_tables(chunks: DataFrame, store) -> dict[str, DataFrame]:
    """What a search reads, each table stored by `store(df, name)` and made from the stored chunks.

    Keywords and postings are lists, a row per chunk.
    """
    chunks = store(chunks, "chunks")
    vectors = store(vector_table(chunks), "vectors")
    keywords = store(keyword_lists(chunks), "keywords")
    index = tm.term_index(chunks, store)
    return dict(zip(SEARCHED, (chunks, vectors, keywords, index.counts, index.terms, index.totals)))


def write_index(spark: SparkSession, docs: DataFrame, folder: str, text_col: str = "text", **params) -> dict[str, DataFrame]:
    """Write chunks, vectors, keywords, postings, term counts and mentions; every later table reads the written chunks.

    Keywords and postings are written as lists, a row per chunk, and given back row by row.
    dept_id and folder_id of a document, if it has them, go with its chunks.
    """
    def store(df: DataFrame, name: str) -> DataFrame:
        if name in ("chunks", "vectors"):
            write_by_document(df, f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    carry = tuple(c for c in ("dept_id", "folder_id") if c in docs.columns)
    tables = search_tables(text_chunk_table(docs, text_col, carry, **params), store)
    write_by_document(mention_table(docs, text_col, **params), f"{folder}/mentions")
    return {**tables, "keywords": tm.keyword_rows(tables["keywords"]), "postings": tm.posting_rows(tables["postings"]),
            "mentions": spark.read.parquet(f"{folder}/mentions")}


def settled(df: DataFrame) -> DataFrame:
    """A table several later steps read, written once to the shared folder."""
    return cut_lineage(df)
