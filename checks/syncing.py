"""Snapshot sync, upserts, integrity and sinks (A2, A6, A7, B)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import part, query, sql
from checks.standins import t
from leafmill.operators import logs as lg
from leafmill.operators import sync as sy
from leafmill.session import shared_dir
from leafmill.sources import files as fl
from leafmill.sources import tables as tb


@query("a2_content_hash", "SELECT page_id, sha256(html) AS hash, length(html) AS size FROM pages")
def a2(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("hash"), F.length("html").cast("long").alias("size"))


def changes(spark, sf, exclude_failed):
    return sy.classify_changes(s.listing(spark, sf), s.docs(spark, sf), exclude_failed)


def sql_changes(where: str) -> str:
    return f"""
  SELECT coalesce(l.path, d.path) AS path, l.hash, l.size, d.doc_id, d.hash AS old_hash,
    CASE WHEN l.path IS NULL THEN 'deleted'
         WHEN d.doc_id IS NOT NULL THEN CASE WHEN l.hash <> d.hash THEN 'modified' ELSE 'same' END
         WHEN l.hash IN (SELECT hash FROM docs WHERE {where}) THEN 'moved'
         WHEN l.path = (SELECT min(n.path) FROM listing n WHERE n.hash = l.hash AND n.path NOT IN (SELECT path FROM docs WHERE {where})) THEN 'added'
         ELSE 'repeated' END AS change
  FROM listing l FULL JOIN (SELECT * FROM docs WHERE {where}) d ON d.path = l.path"""


part("known_changes", sql_changes("status <> 'failed'"), "docs", "listing")
part("all_changes", sql_changes("true"), "docs", "listing")


@query("b1_scan_diff", sql("known_changes", body="SELECT * FROM known_changes"))
def b1(spark, sf):
    return changes(spark, sf, True)


@query("b2_sync_diff", sql("all_changes", body="SELECT * FROM all_changes"))
def b2(spark, sf):
    return changes(spark, sf, False)


@query("b3_apply_diff", sql("all_changes", body="""
  SELECT d.doc_id, d.path, d.file_name, d.type, CASE WHEN change = 'modified' THEN c.hash ELSE d.hash END AS hash,
         CASE WHEN change = 'modified' THEN c.size ELSE d.size END AS size,
         CASE change WHEN 'modified' THEN 'pending' WHEN 'deleted' THEN 'failed' ELSE status END AS status,
         CASE WHEN change = 'deleted' THEN 'File removed from source' ELSE error_msg END AS error_msg,
         CASE WHEN change IN ('modified', 'deleted') THEN TIMESTAMP '2024-01-31' ELSE updated_at END AS updated_at
  FROM docs d LEFT JOIN all_changes c ON c.doc_id = d.doc_id
  UNION ALL
  SELECT NULL, path, regexp_replace(path, '.*/', ''), 'pdf', hash, size, 'pending', NULL, TIMESTAMP '2024-01-31'
  FROM all_changes WHERE change = 'added'"""))
def b3(spark, sf):
    docs = s.docs(spark, sf).select("doc_id", "path", "file_name", "type", "hash", "size", "status", "error_msg", "updated_at")
    rows = sy.apply_changes(changes(spark, sf, False), docs, s.AS_OF)
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("b4_sync_metrics", sql("all_changes", body="""
  SELECT count(*) FILTER (change = 'added') AS files_added, count(*) FILTER (change = 'modified') AS files_modified,
         count(*) FILTER (change = 'deleted') AS files_deleted, count(*) FILTER (change = 'moved') AS files_moved,
         count(*) FILTER (change = 'repeated') AS files_repeated, 'success' AS status FROM all_changes"""))
def b4(spark, sf):
    return sy.sync_metrics(changes(spark, sf, False))


@query("b5_user_upsert", """
  WITH feed AS (
    SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS email, o_orderkey AS ord, o_orderpriority AS usr_name,
           month(o_orderdate)::BIGINT AS dept_id, NULL::BIGINT AS role_id FROM orders
    UNION ALL SELECT s_name, s_suppkey, s_name, s_nationkey, 1 FROM supplier),
  last AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY email ORDER BY ord DESC) = 1)
  SELECT c_custkey AS user_id, coalesce(c_name, f.email) AS email, coalesce(f.usr_name, c_name) AS usr_name,
         coalesce(f.dept_id, c_nationkey) AS dept_id, coalesce(f.role_id, 0) AS role_id,
         CASE WHEN f.email IS NOT NULL AND c_custkey IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS updated_at,
         CASE WHEN c_custkey IS NULL THEN 'added' WHEN f.email IS NOT NULL THEN 'updated' ELSE 'kept' END AS change
  FROM customer FULL JOIN last f ON f.email = c_name""")
def b5(spark, sf):
    users = t(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"), F.col("c_name").alias("usr_name"),
        F.col("c_nationkey").cast("long").alias("dept_id"), F.lit(0).cast("long").alias("role_id"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    orders = t(spark, sf, "orders").select(
        F.format_string("Customer#%09d", "o_custkey").alias("email"), F.col("o_orderkey").alias("ord"),
        F.col("o_orderpriority").alias("usr_name"), F.month("o_orderdate").cast("long").alias("dept_id"),
        F.lit(None).cast("long").alias("role_id"))
    new = t(spark, sf, "supplier").select(
        F.col("s_name").alias("email"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("usr_name"),
        F.col("s_nationkey").cast("long").alias("dept_id"), F.lit(1).cast("long").alias("role_id"))
    rows = sy.upsert_users(users, orders.unionByName(new), s.AS_OF)
    return rows.withColumn("role_id", F.coalesce("role_id", F.lit(0))).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("b6_pending_and_failed", sql("docs", body="SELECT doc_id, status FROM docs WHERE status IN ('pending', 'failed')"))
def b6(spark, sf):
    return sy.documents_with_status(s.docs(spark, sf), "pending", "failed")


def reset_sql(chosen: str) -> str:
    return sql("docs", body=f"""
  SELECT doc_id, {chosen} AS was_reset, CASE WHEN {chosen} THEN 'pending' ELSE status END AS status,
         CASE WHEN {chosen} THEN NULL ELSE error_msg END AS error_msg,
         CASE WHEN {chosen} THEN TIMESTAMP '2024-01-31' ELSE updated_at END AS updated_at FROM docs""")


def reset(spark, sf, ids=None):
    rows = sy.reset_failed(s.docs(spark, sf), s.AS_OF, ids).select("doc_id", "was_reset", "status", "error_msg", "updated_at")
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("b7_reset_all_failed", reset_sql("(status = 'failed')"))
def b7a(spark, sf):
    return reset(spark, sf)


@query("b7_reset_chosen_failed", reset_sql("(status = 'failed' AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))"))
def b7b(spark, sf):
    return reset(spark, sf, t(spark, sf, "documents").filter("lang = 'en'").select("doc_id"))


@query("b7_reset_by_empty_list", reset_sql("coalesce(status = 'failed', false)").replace("FROM docs", "FROM (SELECT * REPLACE (CASE WHEN dept_id <> 'es' THEN status END AS status) FROM docs)"))
def b7c(spark, sf):
    """An empty list of ids means all; a document without a status is left as it is."""
    docs = s.docs(spark, sf).withColumn("status", F.when(F.col("dept_id") != "es", F.col("status")))
    rows = sy.reset_failed(docs, s.AS_OF, docs.select("doc_id").limit(0)).select("doc_id", "was_reset", "status", "error_msg", "updated_at")
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("b8_insert_absent", """
  SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels UNION ALL
  SELECT doc_id, min(n_chars), 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id""")
def b8(spark, sf):
    base = t(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    new = t(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("quality"), F.lit(0).cast("long").alias("toxic"))
    return sy.insert_absent(base, new, ["doc_id"], "quality")


@query("b9_cascade_delete", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey NOT IN (
    SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""")
def b9a(spark, sf):
    gone = t(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    gone_orders = orders.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    items = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sy.cascade_delete(items, gone_orders, "l_orderkey")


@query("b9_set_null", """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN NULL ELSE l_suppkey END AS l_suppkey
  FROM lineitem""")
def b9b(spark, sf):
    gone = t(spark, sf, "supplier").filter("s_acctbal < 0").select("s_suppkey")
    return sy.set_null(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), gone, "l_suppkey", "s_suppkey")


REFERENCES = [sy.Reference("nation", "n_regionkey", "region"), sy.Reference("customer", "c_nationkey", "nation"), sy.Reference("supplier", "s_nationkey", "nation", "set null"),
              sy.Reference("orders", "o_custkey", "customer"), sy.Reference("lineitem", "l_orderkey", "orders"), sy.Reference("lineitem", "l_suppkey", "supplier", "set null")]
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
part("gone_nations", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
part("gone_customers", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM gone_nations)", "gone_nations")
part("gone_orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone_customers)", "gone_customers")
part("gone_suppliers", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")


@query("b9_deletes_along_references", sql("gone_nations", "gone_customers", "gone_orders", "gone_suppliers", body="""
  SELECT 'nation' AS name, n_nationkey::BIGINT AS key, 0::BIGINT AS line, n_regionkey::BIGINT AS refers FROM nation WHERE n_nationkey NOT IN (FROM gone_nations)
  UNION ALL SELECT 'customer', c_custkey, 0, c_nationkey FROM customer WHERE c_custkey NOT IN (FROM gone_customers)
  UNION ALL SELECT 'supplier', s_suppkey, 0, CASE WHEN s_nationkey NOT IN (FROM gone_nations) THEN s_nationkey END FROM supplier WHERE s_suppkey NOT IN (FROM gone_suppliers)
  UNION ALL SELECT 'orders', o_orderkey, 0, o_custkey FROM orders WHERE o_orderkey NOT IN (FROM gone_orders)
  UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber, CASE WHEN l_suppkey NOT IN (FROM gone_suppliers) THEN l_suppkey END FROM lineitem
    WHERE l_orderkey NOT IN (FROM gone_orders)"""))
def b9c(spark, sf):
    """A region and the suppliers in debt go: four levels of cascades, two references set to null."""
    tables = {name: t(spark, sf, name) for name in KEYS}
    left = sy.delete_along(tables, KEYS, REFERENCES, {"region": tables["region"].filter("r_regionkey = 1"), "supplier": tables["supplier"].filter("s_acctbal < 0")})
    shown = {"nation": "n_regionkey", "customer": "c_nationkey", "supplier": "s_nationkey", "orders": "o_custkey", "lineitem": "l_suppkey"}
    out = None
    for name, column in shown.items():
        key, line = KEYS[name][0], KEYS[name][1] if len(KEYS[name]) > 1 else None
        rows = left[name].select(F.lit(name).alias("name"), F.col(key).cast("long").alias("key"), (F.col(line) if line else F.lit(0)).cast("long").alias("line"), F.col(column).cast("long").alias("refers"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("b10_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def b10a(spark, sf):
    return sy.repeated_keys(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("b10_orphans", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def b10b(spark, sf):
    return sy.orphans(t(spark, sf, "documents").select("doc_id", "lang"), t(spark, sf, "labels"), "doc_id")


@query("b11_domain_audit", """
  SELECT doc_id, 'lang' AS column_name, 'domain' AS rule FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
  UNION ALL SELECT doc_id, 'text', 'length' FROM documents WHERE length(text) > 5000
  UNION ALL SELECT d.doc_id, 'quality', 'required' FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL""")
def b11(spark, sf):
    rows = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return sy.domain_violations(rows, ["doc_id"], {"lang": ["en", "fr", "de"]}, {"text": 5000}, ["quality"])


@query("b12_touched_rows", sql("all_changes", body="""
  SELECT doc_id, TIMESTAMP '2024-01-31' AS updated_at FROM all_changes WHERE change IN ('modified', 'deleted')"""))
def b12(spark, sf):
    docs = s.docs(spark, sf)
    after = sy.apply_changes(changes(spark, sf, False), docs.drop("text"), s.AS_OF, "none", "none")
    both = after.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")).join(
        docs.select("doc_id", F.col("updated_at").alias("before")), "doc_id")
    return both.filter("updated_at <> before").select("doc_id", "updated_at")


@query("a6_replace_by_document", """
  SELECT doc_id, token, count(*) AS n FROM (
    SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents WHERE lang <> 'es' AND lang <> 'de'
    UNION ALL SELECT doc_id, unnest(string_split(lower(text), chr(10))) FROM documents WHERE lang = 'es') GROUP BY ALL""")
def a6(spark, sf):
    """Spanish documents are processed again, German ones give no rows any more."""
    docs = t(spark, sf, "documents")
    base = docs.select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    processed = docs.filter("lang IN ('es', 'de')")
    new = docs.filter("lang = 'es'").select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("token"))
    return sy.replace_by_document(base, new, processed).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("a6_replaced_in_a_stored_table", """
  SELECT doc_id, CASE WHEN lang = 'es' THEN lower(text) ELSE text END AS text FROM documents WHERE lang <> 'de'""")
def a6b(spark, sf):
    """The same in a table on disk, read back: Spanish documents replaced, German ones gone."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    docs = t(spark, sf, "documents")
    tb.write_by_document(docs.select("doc_id", "text"), path, 8)
    tb.replace_documents(spark, path, docs.filter("lang = 'es'").select("doc_id", F.lower("text").alias("text")), docs.filter("lang IN ('es', 'de')"))
    return spark.read.parquet(path).drop("doc_bucket")


@query("a7_log_rows", """
  SELECT doc_id, substr(text, 1, 2000) AS message, CASE WHEN lang <> 'en' THEN
    json_object('error_type', lang, 'error_message', substr(source, 1, 1000), 'traceback', right(hash, 2000))::VARCHAR END AS details
  FROM (SELECT *, sha256(text) AS hash FROM documents)""")
def a7(spark, sf):
    rows = t(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("message"), F.when(F.col("lang") != "en", F.col("lang")).alias("error_type"),
        F.col("source").alias("error_message"), F.sha2("text", 256).alias("traceback"))
    return lg.log_rows(rows)


@query("a7_log_rows_with_details", """
  SELECT doc_id, left(text, 20) AS message, CASE
    WHEN lang = 'en' THEN own
    WHEN own IS NULL OR own = '{}' THEN json_object('error_type', lang, 'error_message', source, 'traceback', '-')::VARCHAR
    ELSE '{"n":' || n_chars || ',' || substr(json_object('error_type', lang, 'error_message', source, 'traceback', '-')::VARCHAR, 2) END AS details
  FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN '{"n":' || n_chars || '}' WHEN 1 THEN '{}' END AS own FROM documents)""")
def a7b(spark, sf):
    """An error's fields join the details that came with the event."""
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit("}"))).when(F.col("doc_id") % 3 == 1, "{}")
    return lg.log_rows(t(spark, sf, "documents").select(
        "doc_id", F.substring("text", 1, 20).alias("message"), F.when(F.col("lang") != "en", F.col("lang")).alias("error_type"),
        F.col("source").alias("error_message"), F.lit("-").alias("traceback"), own.alias("details")))


@query("a3_user_feed", """
  SELECT c_name AS email, c_mktsegment AS usr_name, c_nationkey::BIGINT AS dept_id, CASE WHEN c_acctbal > 0 THEN c_custkey END AS role_id
  FROM customer""")
def a3(spark, sf):
    """Customers written as a CSV feed and read back; a role that is no number is lost, not the row."""
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    role = F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).otherwise("none")
    t(spark, sf, "customer").select(F.col("c_name").alias("email"), F.col("c_mktsegment").alias("usr_name"),
                                    F.col("c_nationkey").alias("dept_id"), role.alias("role_id")).write.csv(folder, header=True)
    return fl.read_user_feed(spark, folder).drop("ord")
