"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, folder of the tables) and works on all rows that the one
before it kept; its result is written as Parquet and read again. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import fold, table
from leafmill.llm.decontaminate import clean_documents
from leafmill.llm.near_copies import one_of_each
from leafmill.llm.packing import pack_documents
from leafmill.llm.pii import replace_personal_data
from leafmill.llm.quality import fit_quality, keep_good
from leafmill.llm.queries import PSEUDONYM_KEY, vocabulary
from leafmill.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry scores reject go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return keep_good(docs, fit_quality(docs, labels, fold("doc_id", 5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in windows of the benchmark go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; n_chars follows the text."""
    changed = replace_personal_data(docs, PSEUDONYM_KEY)
    return changed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: its place in a sequence of at most 2048 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]

#: SQL cannot express the learned scores, the pseudonyms or the tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
