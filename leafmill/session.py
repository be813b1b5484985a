"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leafmill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators assume; `settings` override them.

    No operator forces a broadcast: Catalyst and AQE broadcast a side only when
    its size is known to stay under the threshold, and shuffle it otherwise.
    """
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A local folder is made only where the setting is absent and the master is
    local, that is, in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="leafmill-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table to the shared folder and go on from that table.

    The table survives executor loss, its size is known to the planner, and a
    reader takes only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that are kept are written smaller than Spark does by default.
SMALL = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.dictionary.page.size": str(8 << 20)}


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as a table that is kept, in place of what is at `path`, and read it."""
    df.write.mode("overwrite").options(**SMALL).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
