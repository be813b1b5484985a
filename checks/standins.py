"""The engine's tables as views of the given tables, in Spark and in SQL.

Every stand-in covers its whole source table.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import part
from leafmill.functions import text as tx
from leafmill.sources.tables import read_table, spread

HEAVY = ("documents", "pages", "conversations")


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; the text tables are spread over the cores."""
    table = read_table(spark, sf, name)
    return spread(table) if name in HEAVY else table


AS_OF = datetime.datetime(2024, 1, 31)
GRANTS_AS_OF = datetime.datetime(1998, 6, 1)


def cases(column: str, values: dict, default=None):
    out = None
    for key, value in values.items():
        out = F.when(F.col(column) == key, value) if out is None else out.when(F.col(column) == key, value)
    return out.otherwise(default)


def sql_cases(column: str, values: dict, default: str = "NULL") -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {column} = {lit(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {default} END"


# --- the document table: documents with labels ------------------------------

def docs(spark: SparkSession, sf: str) -> DataFrame:
    labels = t(spark, sf, "labels")
    status = (F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "pending").otherwise("indexed"))
    return t(spark, sf, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "text", F.col("lang").alias("dept_id"), F.col("source").alias("folder_id"),
        F.format_string("%s-%d.pdf", "source", "doc_id").alias("file_name"),
        F.format_string("/%s/%s-%d.pdf", "source", "lang", "doc_id").alias("path"), F.lit("pdf").alias("type"),
        F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"), status.alias("status"),
        F.when(F.col("quality") == 0, "low quality").alias("error_msg"),
        F.timestamp_add("SECOND", "n_chars", F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz")).cast("timestamp_ntz").alias("updated_at"))


part("docs", """
  SELECT d.doc_id, text, lang AS dept_id, source AS folder_id, source || '-' || d.doc_id || '.pdf' AS file_name,
         '/' || source || '/' || lang || '-' || d.doc_id || '.pdf' AS path, 'pdf' AS type,
         sha256(text) AS hash, n_chars AS size,
         CASE WHEN quality = 0 THEN 'failed' WHEN toxic = 1 THEN 'pending' ELSE 'indexed' END AS status,
         CASE WHEN quality = 0 THEN 'low quality' END AS error_msg,
         TIMESTAMP '2024-01-01' + to_seconds(n_chars) AS updated_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """A later file listing: toxic documents gone, Spanish ones changed, German ones moved, web pages new."""
    toxic = t(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    kept = docs(spark, sf).join(toxic, "doc_id", "left_anti")
    changed = F.concat("text", F.lit(" v2"))
    text = F.when(F.col("dept_id") == "es", changed).otherwise(F.col("text"))
    path = F.when(F.col("dept_id") == "de", F.concat(F.lit("/moved"), "path")).otherwise(F.col("path"))
    files = kept.select(path.alias("path"), F.sha2(text, 256).alias("hash"), F.length(text).cast("long").alias("size"))
    pages = t(spark, sf, "pages").select(
        F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.sha2("html", 256).alias("hash"), F.length("html").cast("long").alias("size"))
    return files.unionByName(pages)


part("listing", """
  SELECT CASE WHEN dept_id = 'de' THEN '/moved' || path ELSE path END AS path,
         sha256(CASE WHEN dept_id = 'es' THEN text || ' v2' ELSE text END) AS hash,
         length(CASE WHEN dept_id = 'es' THEN text || ' v2' ELSE text END)::BIGINT AS size
  FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL
  SELECT '/pages/' || page_id || '.pdf', sha256(html), length(html)::BIGINT FROM pages""", "docs")


# --- queries, users, grants --------------------------------------------------

SEGMENT_DEPT = {"BUILDING": "en", "AUTOMOBILE": "fr", "MACHINERY": "de", "HOUSEHOLD": "es", "FURNITURE": "en"}


def grants(spark: SparkSession, sf: str) -> DataFrame:
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    items = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.concat(F.lit("src"), F.col("l_linenumber").cast("string")).alias("folder_id"),
        (F.col("l_returnflag") != "R").alias("is_active"),
        F.when(F.col("l_returnflag") != "A", F.col("l_shipdate")).alias("expires_at"))


part("grants", """
  SELECT o_custkey AS user_id, 'src' || l_linenumber AS folder_id, l_returnflag <> 'R' AS is_active,
         CASE WHEN l_returnflag <> 'A' THEN l_shipdate END AS expires_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
part("live", """
  SELECT DISTINCT user_id, folder_id FROM grants
  WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '1998-06-01')""", "grants")


def people(spark: SparkSession, sf: str) -> DataFrame:
    scope = F.when(F.col("c_acctbal") < 0, "dept").when(F.col("c_acctbal") > 5000, "folder").otherwise("all")
    return t(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), cases("c_mktsegment", SEGMENT_DEPT).alias("dept_id"), scope.alias("search_scope"))


part("people", f"""
  SELECT c_custkey AS user_id, {sql_cases('c_mktsegment', SEGMENT_DEPT)} AS dept_id,
         CASE WHEN c_acctbal < 0 THEN 'dept' WHEN c_acctbal > 5000 THEN 'folder' ELSE 'all' END AS search_scope
  FROM customer""")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("item_id").alias("user_id"), F.col("text").alias("query_text"))


part("asked", "SELECT item_id AS query_id, item_id AS user_id, text AS query_text FROM benchmark")


# --- text in SQL --------------------------------------------------------------

def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z가-힣._+\\-/]+', ' ', 'g'), ' ')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_tokens(x: str) -> str:
    """Approximate token length."""
    n = f"length({sql_strip(x)})"
    return f"CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, {n} // 4) END"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def sql_index_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


STOP = ["the", "and", "for", "with", "from", "that", "this", "into", "were", "have"]
TERM_SQL = "[A-Za-z0-9][A-Za-z0-9._+\\-/]{1,63}|[가-힣]{2,20}"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


def sql_terms(source: str, key: str, text: str) -> str:
    """(key, pos, term): distinct candidate terms in first-seen order, pos from 0."""
    return f"""
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY min(i)) - 1 AS pos, term FROM (
    SELECT {key}, unnest(ts) AS term, generate_subscripts(ts, 1) AS i
    FROM (SELECT {key}, regexp_extract_all({sql_norm(text)}, '{TERM_SQL}') AS ts FROM {source})
  ) WHERE term NOT IN {STOP_SQL} GROUP BY {key}, term"""


# chunks of documents: whole if short, else windows of words
part("chunks", f"""
  SELECT doc_id * 16777216 + chunk_idx AS chunk_id, doc_id, chunk_idx, content, {sql_tokens('content')} AS token_cnt FROM (
    SELECT doc_id, 0::BIGINT AS chunk_idx, {sql_strip('text')} AS content FROM documents
    WHERE {sql_tokens('text')} BETWEEN 1 AND 512
    UNION ALL
    SELECT doc_id, s // 462, array_to_string(list_slice(w, s + 1, s + 512), ' ') FROM (
      SELECT doc_id, w, unnest(range(0, len(w), 462)) AS s
      FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents WHERE {sql_tokens('text')} > 512)))""")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a blank line after every sentence, so that they have sections."""
    return t(spark, sf, "documents").select(
        "doc_id", "lang", F.regexp_replace("text", r"\. ", ".\n\n").alias("text"))


part("sentences", "SELECT doc_id, lang, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents")


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a page reader leaves them: a page per line, an image per page, captions on English pages."""
    lines = F.split("text", "\n")
    page = lambda line, i: F.struct(
        (i + 1).alias("page_num"),
        F.when(F.col("lang") == "en", F.concat(F.lit("Figure "), (i + 1).cast("string"), F.lit("\n"), line)).otherwise(line).alias("text"))
    image = lambda line, i: F.struct(F.lit("/images/p.png").alias("path"), (i + 1).alias("page_num"))
    return t(spark, sf, "documents").select(
        "doc_id", "lang", F.col("text").alias("markdown"), F.transform(lines, page).alias("pages"),
        F.transform(lines, image).alias("images"))


part("page_lines", """
  SELECT doc_id, lang, generate_subscripts(ls, 1) AS page, unnest(ls) AS line
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)""")
part("parsed_blocks", f"""
  SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY kind_ord, page, pos) - 1 AS block_idx,
         block_type, source_text, page AS page_number FROM (
    SELECT doc_id, lang, 0 AS kind_ord, page, 0 AS pos, 'caption' AS block_type, 'Figure ' || page AS source_text
    FROM page_lines WHERE lang = 'en'
    UNION ALL
    SELECT doc_id, lang, 0, page, 1,
           CASE WHEN regexp_matches({sql_strip('line')}, '(?i)^(figure|fig\\.|table|표|그림)') THEN 'caption' ELSE 'text' END,
           {sql_strip('line')} FROM page_lines WHERE {sql_strip('line')} <> ''
    UNION ALL
    SELECT doc_id, lang, 1, page, 2, 'image', 'Extracted image ' || page || ' from page ' || page FROM page_lines)""",
     "page_lines")


# --- order sheets: a grid per order -------------------------------------------

GRID_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Grid cells of every order: a header row, then a row per line of 2, 3 or 4 cells."""
    from pyspark.sql import Window
    items = t(spark, sf, "lineitem")
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*GRID_ORDER))
    text = lambda c: F.col(c).cast("long").cast("string")
    values = F.when(F.col("l_returnflag") == "R", F.array(text("l_partkey"), text("l_quantity"))).when(
        F.col("l_returnflag") == "N", F.array(text("l_partkey"), text("l_quantity"), F.col("l_linestatus"))).otherwise(
        F.array(text("l_partkey"), text("l_quantity"), F.col("l_linestatus"), F.lit("cut")))
    body = items.withColumn("row", row.cast("int")).select(F.col("l_orderkey").alias("doc_id"), "row", F.posexplode(values).alias("col", "text"))
    header = items.select(F.col("l_orderkey").alias("doc_id")).distinct().select(
        "doc_id", F.lit(0).alias("row"), F.posexplode(tx.words_of(["part", "quantity", "status"])).alias("col", "text"))
    return header.unionByName(body)


part("grid", f"""
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(GRID_ORDER)}) AS r,
         l_partkey::BIGINT::VARCHAR AS a, l_quantity::BIGINT::VARCHAR AS b,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus END AS c, l_returnflag = 'A' AS has_d
  FROM lineitem""")
part("grid_md", """
  SELECT doc_id, '| part | quantity | status |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
         string_agg('| ' || a || ' | ' || b || ' | ' || coalesce(c, '') || ' |', chr(10) ORDER BY r) AS source_text
  FROM grid GROUP BY doc_id""", "grid")


# --- operational tables: orders, lineitem, customer, events --------------------

STATUS = {"F": "indexed", "O": "pending", "P": "failed"}


def order_docs(spark: SparkSession, sf: str) -> DataFrame:
    who = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dept_id"),
                                          F.col("c_mktsegment").alias("role_id"))
    return t(spark, sf, "orders").join(who, "o_custkey", "left").select(
        F.col("o_orderkey").alias("doc_id"), F.format_string("order-%d.pdf", "o_orderkey").alias("file_name"),
        F.format_string("/%s/%d.pdf", "o_orderpriority", "o_orderkey").alias("path"), F.lit("pdf").alias("type"),
        cases("o_orderstatus", STATUS).alias("status"), "dept_id", "role_id", F.col("o_orderpriority").alias("folder_id"),
        F.when(F.col("o_orderstatus") == "P", "late").alias("error_msg"), F.col("o_orderdate").alias("updated_at"))


part("order_docs", f"""
  SELECT o_orderkey AS doc_id, 'order-' || o_orderkey || '.pdf' AS file_name,
         '/' || o_orderpriority || '/' || o_orderkey || '.pdf' AS path, 'pdf' AS type,
         {sql_cases('o_orderstatus', STATUS)} AS status, c_nationkey AS dept_id, c_mktsegment AS role_id,
         o_orderpriority AS folder_id, CASE WHEN o_orderstatus = 'P' THEN 'late' END AS error_msg, o_orderdate AS updated_at
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")


def departments(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("dept_id"), F.col("n_name").alias("dept_name"))


def roles(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_mktsegment").alias("role_id")).distinct().withColumn(
        "role_name", F.lower("role_id"))


def folders(spark, sf):
    return t(spark, sf, "orders").filter("o_orderpriority <> '4-NOT SPECIFIED'").select(
        F.col("o_orderpriority").alias("folder_id")).distinct().withColumn("folder_name", F.substring("folder_id", 3, 100))


part("departments", "SELECT n_nationkey AS dept_id, n_name AS dept_name FROM nation")
part("roles", "SELECT DISTINCT c_mktsegment AS role_id, lower(c_mktsegment) AS role_name FROM customer")
part("folders", """SELECT DISTINCT o_orderpriority AS folder_id, substr(o_orderpriority, 3) AS folder_name
  FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""")


def order_parts(spark, sf) -> dict[str, DataFrame]:
    items = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_returnflag", "l_partkey", "l_suppkey")
    by = lambda flag: items.filter(F.col("l_returnflag") == flag)
    return {"chunk": items, "block": by("A"), "image": by("R"), "entity": by("N")}


def users(spark, sf):
    return t(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("usr_name"), F.col("c_nationkey").alias("dept_id"),
        F.col("c_mktsegment").alias("role_id"))


part("users", "SELECT c_custkey AS user_id, c_name AS usr_name, c_nationkey AS dept_id, c_mktsegment AS role_id FROM customer")


def query_logs(spark, sf):
    return t(spark, sf, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("props").alias("prompt"), F.col("value").alias("latency_ms"),
        F.col("ts").alias("created_at"))


part("query_logs", "SELECT event_id AS id, user_id, props AS prompt, value AS latency_ms, ts AS created_at FROM events")

MODULE = {"click": "serving", "view": "serving", "purchase": "indexing", "signup": "sync", "error": "system"}


def event_logs(spark, sf):
    severity = F.when(F.col("value") > 150, "error").when(F.col("value") > 80, "warning").otherwise("info")
    return t(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("trace_id"), cases("event_type", MODULE).alias("module"),
        "event_type", severity.alias("severity"), "user_id", F.col("props").alias("details"),
        F.when(F.col("value") >= 5, F.col("value")).alias("duration_ms"), F.col("ts").alias("created_at"))


part("event_logs", f"""
  SELECT event_id AS id, user_id::VARCHAR AS trace_id, {sql_cases('event_type', MODULE)} AS module, event_type,
         CASE WHEN value > 150 THEN 'error' WHEN value > 80 THEN 'warning' ELSE 'info' END AS severity,
         user_id, props AS details, CASE WHEN value >= 5 THEN value END AS duration_ms, ts AS created_at
  FROM events""")

STAGE = {"click": "chunk", "view": "embed", "purchase": "index", "signup": "mineru_parse", "error": "graph_extract"}


def stage_logs(spark, sf):
    status = F.when(F.col("value") > 100, "failed").when(F.col("value") > 40, "success").otherwise("running")
    rows = t(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), cases("event_type", STAGE).alias("stage"),
        status.alias("status"), F.col("ts").alias("started_at"), F.col("props").alias("error_message"))
    return rows.withColumn("finished_at", F.when(F.col("status") != "running", F.col("started_at")))


part("stage_logs", f"""
  SELECT *, CASE WHEN status <> 'running' THEN started_at END AS finished_at FROM (
    SELECT event_id AS id, user_id AS doc_id, {sql_cases('event_type', STAGE)} AS stage,
           CASE WHEN value > 100 THEN 'failed' WHEN value > 40 THEN 'success' ELSE 'running' END AS status,
           ts AS started_at, props AS error_message FROM events)""")


def stage_events(spark, sf):
    """Starts and ends in turn of two stages per user."""
    status = F.when(F.col("event_type").isin("click", "view"), "running").when(F.col("event_type") == "error", "failed").otherwise("success")
    return t(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("doc_id"), F.when(F.col("value") > 30, "embed").otherwise("chunk").alias("stage"),
        status.alias("status"), "ts", F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


part("stage_events", """
  SELECT event_id AS ord, user_id AS doc_id, CASE WHEN value > 30 THEN 'embed' ELSE 'chunk' END AS stage,
         CASE WHEN event_type IN ('click', 'view') THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         ts, CASE WHEN event_type = 'error' THEN props END AS error FROM events""")


def timed_events(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "view"), "stage_start").when(F.col("event_type") == "error", "stage_fail").otherwise("stage_end")
    return t(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("trace_id"), F.when(F.col("value") > 30, "embed").otherwise("chunk").alias("stage"),
        kind.alias("event_type"), "ts", F.when(F.col("value") > 150, "error").otherwise("info").alias("severity"))


part("timed_events", """
  SELECT event_id AS ord, user_id AS trace_id, CASE WHEN value > 30 THEN 'embed' ELSE 'chunk' END AS stage,
         CASE WHEN event_type IN ('click', 'view') THEN 'stage_start' WHEN event_type = 'error' THEN 'stage_fail' ELSE 'stage_end' END AS event_type,
         ts, CASE WHEN value > 150 THEN 'error' ELSE 'info' END AS severity FROM events""")

SYNC_TYPE = {"1-URGENT": "user", "2-HIGH": "file", "3-MEDIUM": "full"}
SYNC_STATUS = {"F": "success", "O": "running", "P": "failed"}


def sync_logs(spark, sf):
    return t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), cases("o_orderpriority", SYNC_TYPE, "incremental").alias("sync_type"),
        cases("o_orderstatus", SYNC_STATUS).alias("status"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.floor("o_totalprice").cast("long")).alias("files_added"),
        F.col("o_custkey").alias("files_modified"), F.lit(0).cast("long").alias("files_deleted"))


part("sync_logs", f"""
  SELECT o_orderkey AS id, {sql_cases('o_orderpriority', SYNC_TYPE, "'incremental'")} AS sync_type,
         {sql_cases('o_orderstatus', SYNC_STATUS)} AS status, o_orderdate AS started_at,
         CASE WHEN o_orderstatus <> 'O' THEN floor(o_totalprice)::BIGINT END AS files_added, o_custkey AS files_modified,
         0::BIGINT AS files_deleted FROM orders""")
