"""File listings, page files and user feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as fv

PARSED = ("doc_id long, markdown string, total_pages int, "
          "pages array<struct<page_num:int,text:string>>, images array<struct<path:string,page_num:int>>")
USER_FEED = "email string, usr_name string, dept_id string, role_id string"


def scan_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, name, ext, size, hash) of the supported files under a folder.

    The suffix test reads only names: files of other types are dropped before
    their bytes are read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
             .option("pathGlobFilter", "*.{" + ",".join(_any_case(t) for t in fv.SUPPORTED_TYPES) + "}")
             .load(folder))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)).alias("ext"),
        F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def read_user_feed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of users; numbers that do not parse become null instead of failing the job.

    `ord` follows file and line order, so that the last row of an email can win.
    """
    rows = spark.read.schema(USER_FEED).csv(path, header=True)
    return rows.select(
        "email", "usr_name", F.expr("try_cast(dept_id AS BIGINT)").alias("dept_id"),
        F.expr("try_cast(role_id AS BIGINT)").alias("role_id"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("ord"))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Documents as page readers leave them: one JSON object per document."""
    return spark.read.schema(PARSED).json(path)


def parsed_pages(parsed: DataFrame) -> DataFrame:
    """(doc_id, page_num, text); a document without pages gives its markdown as one unnumbered page."""
    whole = F.array(F.struct(F.lit(None).cast("int").alias("page_num"), F.col("markdown").alias("text")))
    pages = F.when(F.coalesce(F.size("pages"), F.lit(0)) > 0, F.col("pages")).otherwise(whole)
    return parsed.select("doc_id", F.posexplode(pages).alias("pos", "p")).select("doc_id", "pos", "p.page_num", "p.text")
