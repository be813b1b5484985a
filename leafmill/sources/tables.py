"""Parquet tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.logs import log_rows
from leafmill.operators.sync import replace_by_document

#: Rows that a bucket of a new table holds, about, and how few buckets it has at least.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 16


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, for work that is heavy per row on a table of few splits.

    A table with at least a split per core, as on a cluster, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def layout_path(path: str) -> str:
    return f"{path.rstrip('/')}.layout"


def stored_buckets(spark: SparkSession, path: str) -> int:
    """How many buckets the table at `path` was written with."""
    return spark.read.parquet(layout_path(path)).first()["buckets"]


def write_by_document(df: DataFrame, path: str, buckets: int | None = None, doc: str = "doc_id") -> None:
    """Write a table whose folders are buckets of the document id.

    Without `buckets` their number follows the rows. It is stored beside the table, so
    that no later writer can take another. The rebalance hint gathers a bucket's rows
    into few files and splits a bucket that is much larger than the others.
    """
    if buckets is None:
        buckets = max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))
    df.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(layout_path(path))
    keyed = df.withColumn("doc_bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int"))
    keyed.hint("rebalance", F.col("doc_bucket")).write.mode("overwrite").partitionBy("doc_bucket").parquet(path)


def replace_documents(spark: SparkSession, path: str, new: DataFrame, processed: DataFrame,
                      doc: str = "doc_id") -> None:
    """Replace the rows of the processed documents in a stored table.

    Only the buckets that hold a processed document are read and written. The
    new content is first written beside the table, since a job must not read
    the files it replaces.
    """
    from leafmill.session import cut_lineage

    buckets = stored_buckets(spark, path)
    bucket = F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int").alias("doc_bucket")
    touched = [r["doc_bucket"] for r in processed.select(bucket).distinct().collect()]  # at most `buckets` rows
    base = spark.read.parquet(path).filter(F.col("doc_bucket").isin(touched))
    fresh = new.withColumn("doc_bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")).select(*base.columns)
    merged = cut_lineage(replace_by_document(base, fresh, processed, doc))
    left = {r["doc_bucket"] for r in merged.select("doc_bucket").distinct().collect()}
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)
    empty = spark.createDataFrame([], base.drop("doc_bucket").schema)
    for bucket_id in sorted(set(touched) - left):  # dynamic overwrite leaves a bucket without rows as it was
        empty.write.mode("overwrite").parquet(f"{path}/doc_bucket={bucket_id}")


def append_log(events: DataFrame, path: str, time: str = "created_at") -> None:
    """Append events as log rows, one folder per day."""
    log_rows(events).withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)
