"""Reports, logs and listings (A5, A8, I, J)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import part, query, sql
from leafmill.operators import logs as lg
from leafmill.operators import reports as rp
from checks.standins import t

AS_OF = s.AS_OF
A = "TIMESTAMP '2024-01-31'"


@query("a5_table_scan", "SELECT event_id, ts, user_id, event_type, value FROM events")
def a5(spark, sf):
    return t(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("a8_paged_listing", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 50 OFFSET 100")
def a8(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rp.page_of(rows, [F.desc("c_acctbal"), F.desc("c_custkey")], 50, 100)


@query("i1_status_totals", sql("order_docs", body="""
  SELECT count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed,
         count(*) FILTER (status IN ('pending', 'processing')) AS pending FROM order_docs"""))
def i1(spark, sf):
    return rp.status_totals(s.order_docs(spark, sf))


def base(spark, sf):
    return rp.document_base(s.order_docs(spark, sf), s.departments(spark, sf), s.roles(spark, sf), s.folders(spark, sf),
                            s.order_parts(spark, sf))


part("base", """
  SELECT d.*, dept_name, role_name, folder_name,
         coalesce(chunk_count, 0) AS chunk_count, coalesce(block_count, 0) AS block_count,
         coalesce(image_count, 0) AS image_count, coalesce(entity_count, 0) AS entity_count
  FROM order_docs d LEFT JOIN departments USING (dept_id) LEFT JOIN roles USING (role_id) LEFT JOIN folders USING (folder_id)
  LEFT JOIN (SELECT l_orderkey AS doc_id, count(*) AS chunk_count, count(*) FILTER (l_returnflag = 'A') AS block_count,
                    count(*) FILTER (l_returnflag = 'R') AS image_count, count(*) FILTER (l_returnflag = 'N') AS entity_count
             FROM lineitem GROUP BY 1) USING (doc_id)""", "order_docs", "departments", "roles", "folders")


@query("i2_document_base", sql("base", body="SELECT * FROM base"))
def i2(spark, sf):
    return base(spark, sf)


@query("i3_document_list", sql("base", body="""
  SELECT * FROM base WHERE status = 'indexed' AND (file_name ILIKE '%er-1_3%' OR path ILIKE '%er-1_3%' OR type ILIKE '%er-1_3%')
  ORDER BY updated_at DESC, doc_id DESC LIMIT 50"""))
def i3(spark, sf):
    return rp.document_list(base(spark, sf), "indexed", "er-1_3")


def logged_docs(spark, sf):
    return s.order_docs(spark, sf).select("doc_id", "file_name", "status")


@query("i4_document_detail_logs", sql("stage_logs", "order_docs", body="""
  SELECT id, l.doc_id, file_name, stage, l.status, started_at, finished_at, error_message, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY started_at DESC, id DESC) AS rank FROM stage_logs
    WHERE doc_id IN (SELECT doc_id FROM order_docs)) l LEFT JOIN order_docs d USING (doc_id) WHERE rank <= 10"""))
def i4_logs(spark, sf):
    docs = logged_docs(spark, sf)
    return rp.document_logs(docs, s.stage_logs(spark, sf), docs).withColumn("rank", F.col("rank").cast("long"))


def longs(rows):
    return rows.withColumn("block_idx", F.col("block_idx").cast("long")).withColumn("rank", F.col("rank").cast("long"))


def line_blocks(spark, sf):
    lines = F.posexplode(F.split("text", "\n")).alias("block_idx", "source_text")
    return t(spark, sf, "documents").select("doc_id", F.col("lang").alias("block_type"), lines)


part("line_blocks", """
  SELECT doc_id, lang AS block_type, generate_subscripts(ls, 1) - 1 AS block_idx, unnest(ls) AS source_text
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)""")
PREVIEW = "CASE WHEN length(source_text) <= 240 THEN source_text ELSE substr(source_text, 1, 237) || '...' END AS preview_text"


@query("i4_document_detail_blocks", sql("line_blocks", body=f"""
  SELECT *, {PREVIEW} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS rank FROM line_blocks)
  WHERE rank <= 24"""))
def i4_blocks(spark, sf):
    return longs(rp.document_blocks(line_blocks(spark, sf), t(spark, sf, "documents")))


@query("i5_block_list", sql("line_blocks", body=f"""
  SELECT *, {PREVIEW} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS rank FROM line_blocks
  WHERE block_type = 'fr') WHERE rank <= 100"""))
def i5(spark, sf):
    return longs(rp.document_blocks(line_blocks(spark, sf), block_type="fr", keep=100))


@query("i6_active_users", sql("query_logs", body=f"SELECT count(DISTINCT user_id) AS active_users FROM query_logs WHERE created_at >= {A} - INTERVAL 7 DAY"))
def i6(spark, sf):
    return rp.active_users(s.query_logs(spark, sf), AS_OF)


@query("i7_recent_queries", sql("query_logs", body=f"SELECT count(*) AS queries FROM query_logs WHERE created_at >= {A} - INTERVAL 7 DAY"))
def i7(spark, sf):
    return rp.recent_queries(s.query_logs(spark, sf), AS_OF)


@query("i8_running_stages", sql("stage_logs", body="""
  SELECT doc_id, stage, id FROM stage_logs WHERE status = 'running' AND finished_at IS NULL
  AND id IN (SELECT max(id) FROM stage_logs GROUP BY doc_id, stage)"""))
def i8(spark, sf):
    return rp.running_stages(s.stage_logs(spark, sf))


@query("i9_recent_errors", sql("event_logs", body=f"SELECT count(*) AS errors FROM event_logs WHERE severity = 'error' AND created_at >= {A} - INTERVAL 24 HOUR"))
def i9(spark, sf):
    return rp.recent_errors(s.event_logs(spark, sf), AS_OF)


@query("i10_latest_failures", sql("stage_logs", "order_docs", body="""
  SELECT l.id, l.doc_id, l.stage, l.status, l.started_at, l.error_message, l.finished_at, d.file_name
  FROM (SELECT * FROM stage_logs WHERE status = 'failed' ORDER BY started_at DESC, id DESC LIMIT 5) l
  LEFT JOIN order_docs d ON d.doc_id = l.doc_id"""))
def i10a(spark, sf):
    return rp.latest_failures(s.stage_logs(spark, sf), s.order_docs(spark, sf))


@query("i10_latest_syncs", sql("sync_logs", body="""
  SELECT id, sync_type, status, started_at, coalesce(files_added, 0) AS files_added, files_modified, files_deleted
  FROM sync_logs ORDER BY started_at DESC, id DESC LIMIT 5"""))
def i10b(spark, sf):
    return rp.latest_syncs(s.sync_logs(spark, sf))


def summary(spark, sf):
    return rp.system_summary(s.order_docs(spark, sf), s.query_logs(spark, sf), s.stage_logs(spark, sf),
                             s.event_logs(spark, sf), s.sync_logs(spark, sf), AS_OF)


part("summary", f"""
  SELECT count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status IN ('pending', 'processing')) AS pending,
    (SELECT count(DISTINCT user_id) FROM query_logs WHERE created_at >= {A} - INTERVAL 7 DAY) AS active_users_7d,
    (SELECT count(*) FROM query_logs WHERE created_at >= {A} - INTERVAL 7 DAY) AS queries_7d,
    (SELECT count(*) FROM stage_logs WHERE status = 'running' AND id IN (SELECT max(id) FROM stage_logs GROUP BY doc_id, stage)) AS running_stages,
    (SELECT count(*) FROM event_logs WHERE severity = 'error' AND created_at >= {A} - INTERVAL 24 HOUR) AS event_errors_24h,
    (SELECT least(5, count(*)) FROM stage_logs WHERE status = 'failed') AS recent_failures,
    (SELECT least(5, count(*)) FROM sync_logs) AS recent_syncs
  FROM order_docs""", "order_docs", "query_logs", "stage_logs", "event_logs", "sync_logs")


@query("i11_system_summary", sql("summary", body="SELECT * FROM summary"))
def i11(spark, sf):
    return summary(spark, sf)


@query("i26_health_score", sql("summary", body="""
  SELECT *, greatest(25, 100 - recent_failures * 10 - event_errors_24h * 5 - failed * 2) AS health_score FROM summary"""))
def i26(spark, sf):
    return rp.health_score(summary(spark, sf))


part("daily", f"""
  SELECT created_at::DATE AS date, count(*) AS query_count, round(nullif(avg(latency_ms), 0), 1) AS avg_latency_ms
  FROM query_logs WHERE created_at >= {A} - INTERVAL 30 DAY GROUP BY 1""", "query_logs")


@query("i12_daily_stats", sql("daily", body="SELECT * FROM daily"))
def i12(spark, sf):
    return rp.daily_stats(s.query_logs(spark, sf), AS_OF)


@query("i13_count_by_status", sql("order_docs", body="SELECT status, count(*) AS n FROM order_docs GROUP BY 1"))
def i13(spark, sf):
    return rp.count_by(s.order_docs(spark, sf), "status")


@query("i14_top_users", sql("query_logs", "users", body="""
  SELECT q.user_id, coalesce(usr_name, 'Unknown') AS usr_name, query_count
  FROM (SELECT user_id, count(*) AS query_count FROM query_logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) q
  LEFT JOIN users u ON u.user_id = q.user_id"""))
def i14(spark, sf):
    return rp.top_users(s.query_logs(spark, sf), s.users(spark, sf))


@query("i15_module_stats", sql("event_logs", body=f"""
  SELECT module, count(*) AS total_events, count(*) FILTER (severity = 'error') AS errors,
         count(*) FILTER (severity = 'warning') AS warnings, round(nullif(avg(duration_ms), 0), 1) AS avg_duration_ms
  FROM event_logs WHERE created_at >= {A} - INTERVAL 7 DAY GROUP BY 1"""))
def i15(spark, sf):
    return rp.module_stats(s.event_logs(spark, sf), AS_OF)


@query("i16_query_log_list", sql("query_logs", body="""
  SELECT id, user_id, substr(prompt, 1, 200) AS prompt, latency_ms, created_at FROM query_logs
  WHERE user_id = 8 AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20'
  ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5"""))
def i16(spark, sf):
    return rp.query_log_list(s.query_logs(spark, sf), 8, datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20), 20, 5)


@query("i17_stage_log_list", sql("stage_logs", "order_docs", body="""
  SELECT l.*, d.file_name FROM (SELECT * FROM stage_logs WHERE status = 'failed' AND stage = 'embed'
  ORDER BY started_at DESC, id DESC LIMIT 50 OFFSET 10) l LEFT JOIN order_docs d ON d.doc_id = l.doc_id"""))
def i17(spark, sf):
    return rp.stage_log_list(s.stage_logs(spark, sf), s.order_docs(spark, sf), "failed", "embed", 50, 10)


@query("i18_event_log_list", sql("event_logs", body="""
  SELECT * FROM event_logs WHERE module = 'serving' AND severity = 'warning' AND event_type = 'view'
  ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20"""))
def i18(spark, sf):
    return rp.event_log_list(s.event_logs(spark, sf), 50, 20, module="serving", severity="warning", event_type="view", user_id=None)


@query("i19_audit_list", "SELECT event_id AS id, user_id, event_type AS action_type, ts AS created_at FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 50")
def i19a(spark, sf):
    audit = t(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action_type"), F.col("ts").alias("created_at"))
    return rp.page_of(rp.equal_filters(audit, action_type="signup"), [F.desc("created_at"), F.desc("id")])


@query("i19_sync_list", sql("sync_logs", body="SELECT * FROM sync_logs WHERE sync_type = 'file' AND status = 'success' ORDER BY started_at DESC, id DESC LIMIT 50"))
def i19b(spark, sf):
    return rp.page_of(rp.equal_filters(s.sync_logs(spark, sf), sync_type="file", status="success"), [F.desc("started_at"), F.desc("id")])


USER_LIST = "SELECT u.*, dept_name, role_name FROM users u {how} JOIN departments USING (dept_id) {how} JOIN roles USING (role_id)"


@query("i20_user_list", sql("users", "departments", "roles", body=USER_LIST.format(how="LEFT")))
def i20a(spark, sf):
    return rp.user_list(s.users(spark, sf), s.roles(spark, sf), s.departments(spark, sf))


@query("i20_user_dashboard", sql("users", "departments", "roles", body=USER_LIST.format(how="INNER")))
def i20b(spark, sf):
    return rp.user_list(s.users(spark, sf), s.roles(spark, sf), s.departments(spark, sf), "inner")


@query("i21_user_activity", sql("users", "departments", "roles", body="""
  SELECT u.user_id, usr_name, dept_name AS department, role_name, count(event_id) AS total_actions,
         count(event_id) FILTER (event_type = 'view') AS total_queries, max(ts) AS last_activity
  FROM users u JOIN departments USING (dept_id) JOIN roles USING (role_id) LEFT JOIN events e ON e.user_id = u.user_id
  GROUP BY ALL"""))
def i21(spark, sf):
    audit = t(spark, sf, "events").select("user_id", F.col("event_type").alias("action_type"), F.col("ts").alias("created_at"))
    return rp.user_activity(s.users(spark, sf), s.departments(spark, sf), s.roles(spark, sf), audit, "view")


@query("i22_document_stats", sql("base", body="""
  SELECT doc_id, file_name, dept_name AS department, role_name, folder_name, status, chunk_count, updated_at
  FROM base WHERE dept_name IS NOT NULL AND role_name IS NOT NULL"""))
def i22(spark, sf):
    rows = rp.document_stats(s.order_docs(spark, sf), s.departments(spark, sf), s.roles(spark, sf), s.folders(spark, sf),
                             s.order_parts(spark, sf)["chunk"])
    return rows.select("doc_id", "file_name", "department", "role_name", "folder_name", "status", "chunk_count", "updated_at")


@query("i23_indexed_by_department", sql("base", body="""
  SELECT dept_name AS department, count(*) AS n_docs FROM base WHERE status = 'indexed' AND dept_name IS NOT NULL GROUP BY 1"""))
def i23(spark, sf):
    return rp.indexed_by_department(s.order_docs(spark, sf), s.departments(spark, sf))


@query("i24_sync_history", sql("sync_logs", body="""
  SELECT *, coalesce(files_added, 0) + files_modified + files_deleted AS files_changed
  FROM sync_logs ORDER BY started_at DESC, id DESC LIMIT 100"""))
def i24a(spark, sf):
    return rp.sync_history(s.sync_logs(spark, sf))


@query("i24_error_list", sql("stage_logs", "order_docs", body="""
  SELECT l.*, d.file_name FROM stage_logs l JOIN order_docs d ON d.doc_id = l.doc_id WHERE l.status = 'failed'
  ORDER BY l.started_at DESC, l.id DESC LIMIT 100"""))
def i24b(spark, sf):
    return rp.latest_failures(s.stage_logs(spark, sf), s.order_docs(spark, sf), 100, "inner")


@query("i25_distinct_part_counts", """
  SELECT o_orderkey AS doc_id, coalesce(p, 0) AS part_count, coalesce(q, 0) AS supplier_count
  FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS q FROM lineitem GROUP BY 1)
  ON l_orderkey = o_orderkey""")
def i25(spark, sf):
    items = s.order_parts(spark, sf)["chunk"]
    docs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return rp.distinct_part_counts(docs, {"part": (items, "l_partkey"), "supplier": (items, "l_suppkey")})


@query("i27_dashboard_totals", sql("daily", "order_docs", body="""
  SELECT sum(query_count)::BIGINT AS total_queries, round(avg(avg_latency_ms), 0) AS avg_latency_ms,
         (SELECT count(*) FROM order_docs) AS total_docs, (SELECT count(*) FROM order_docs WHERE status = 'indexed') AS indexed_docs
  FROM daily"""))
def i27(spark, sf):
    return rp.dashboard_totals(rp.daily_stats(s.query_logs(spark, sf), AS_OF), rp.count_by(s.order_docs(spark, sf), "status"))


# --- stage and event logs ------------------------------------------------------

part("numbered_events", "SELECT *, row_number() OVER (PARTITION BY doc_id, stage ORDER BY ts, ord) AS i FROM stage_events", "stage_events")
# the open starts of each group as a stack, one event at a time
part("stacks", """RECURSIVE
  SELECT doc_id, stage, i, CASE WHEN status = 'running' THEN [ord] ELSE []::BIGINT[] END AS stack,
         CASE WHEN status <> 'running' THEN -1 END::BIGINT AS closed
  FROM numbered_events WHERE i = 1
  UNION ALL
  SELECT e.doc_id, e.stage, e.i, CASE WHEN e.status = 'running' THEN list_append(stack, e.ord) ELSE list_slice(stack, 1, len(stack) - 1) END,
         CASE WHEN e.status <> 'running' THEN coalesce(stack[len(stack)], -1) END
  FROM stacks s JOIN numbered_events e ON e.doc_id = s.doc_id AND e.stage = s.stage AND e.i = s.i + 1""", "numbered_events")
part("closed_stages", """
  SELECT e.doc_id, e.stage, CASE WHEN closed = -1 THEN e.ord ELSE closed END AS ord, coalesce(b.ts, e.ts) AS started_at, e.status,
         e.ts AS finished_at, e.error
  FROM stacks s JOIN numbered_events e USING (doc_id, stage, i) LEFT JOIN stage_events b ON b.ord = s.closed WHERE closed IS NOT NULL
  UNION ALL
  SELECT doc_id, stage, ord, ts, status, NULL, error FROM stage_events
  WHERE status = 'running' AND ord NOT IN (SELECT closed FROM stacks WHERE closed IS NOT NULL)""", "stacks")


@query("j1_close_stages", sql("closed_stages", body="SELECT * FROM closed_stages"))
def j1(spark, sf):
    return lg.close_stages(s.stage_events(spark, sf))


@query("j2_document_states", sql("closed_stages", body=f"""
  , newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, stage ORDER BY started_at DESC, ord DESC) AS r
               FROM closed_stages) WHERE r = 1),
  seen AS (SELECT doc_id, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'running') AS r,
           arg_min(substr(error, 1, 1000), stage) FILTER (status = 'failed') AS e FROM newest GROUP BY doc_id)
  SELECT c_custkey AS doc_id, CASE WHEN f IS NULL THEN 'pending' WHEN f > 0 THEN 'failed' WHEN r > 0 THEN 'processing' ELSE 'indexed' END AS status,
         e AS error_msg, CASE WHEN f IS NOT NULL THEN {A} END AS updated_at
  FROM customer LEFT JOIN seen ON doc_id = c_custkey""").replace("\n, newest", ", newest"))
def j2(spark, sf):
    docs = t(spark, sf, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_msg"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    rows = lg.document_states(docs, lg.close_stages(s.stage_events(spark, sf)), AS_OF)
    return rows.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("j3_stage_counts", """
  SELECT o_orderkey AS doc_id, '{"chunks":' || coalesce(c, 0) || ',"images":' || coalesce(i, 0) || '}' AS metadata
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c, nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS i FROM lineitem GROUP BY 1)
  ON l_orderkey = o_orderkey""")
def j3(spark, sf):
    parts = s.order_parts(spark, sf)
    return lg.stage_counts(t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")),
                           {"chunks": parts["chunk"], "images": parts["image"]})


@query("j4_status_timeline", sql("stage_logs", "order_docs", body="""
  SELECT l.*, d.status AS doc_status, row_number() OVER (PARTITION BY l.doc_id ORDER BY started_at DESC, id DESC) AS place
  FROM stage_logs l JOIN order_docs d ON d.doc_id = l.doc_id"""))
def j4(spark, sf):
    return lg.status_timeline(s.order_docs(spark, sf), s.stage_logs(spark, sf))


@query("j4_timeline_without_times", sql("stage_logs", "order_docs", body="""
  SELECT l.*, d.status AS doc_status, row_number() OVER (PARTITION BY l.doc_id ORDER BY started_at DESC NULLS LAST, id DESC) AS place
  FROM (SELECT * REPLACE (CASE WHEN id % 5 > 0 THEN started_at END AS started_at) FROM stage_logs) l JOIN order_docs d ON d.doc_id = l.doc_id"""))
def j4b(spark, sf):
    """Rows without a start time stay, last."""
    logs = s.stage_logs(spark, sf).withColumn("started_at", F.when(F.col("id") % 5 > 0, F.col("started_at")))
    return lg.status_timeline(s.order_docs(spark, sf), logs)


@query("j5_timed_pairs", sql("timed_events", body="""
  SELECT e.trace_id, e.stage, b.ord AS start_ord, e.ord AS end_ord, e.event_type, b.ts AS started_at, e.ts AS ended_at,
         date_diff('microsecond', b.ts, e.ts) // 1000 AS duration_ms
  FROM timed_events e ASOF JOIN (SELECT * FROM timed_events WHERE event_type = 'stage_start') b
  ON b.trace_id = e.trace_id AND b.stage = e.stage AND b.ts <= e.ts WHERE e.event_type <> 'stage_start'"""))
def j5(spark, sf):
    return lg.timed_pairs(s.timed_events(spark, sf))


@query("j6_classify_requests", """
  SELECT o_orderkey, severity, CASE WHEN severity IS NULL THEN NULL WHEN ms > 2000 THEN 'Slow request: ' || line ELSE line END AS message FROM (
    SELECT *, CASE WHEN path IN ('/health', '/docs') OR path LIKE '/admin/%' THEN NULL WHEN ms > 2000 OR status >= 400 THEN 'warning' END AS severity,
           'GET ' || path || ' → ' || status AS line FROM (
      SELECT o_orderkey, floor(o_totalprice / 100)::BIGINT AS ms, CASE o_orderstatus WHEN 'P' THEN 404 ELSE 200 END AS status,
             CASE o_orderpriority WHEN '1-URGENT' THEN '/health' WHEN '2-HIGH' THEN '/admin/users' WHEN '3-MEDIUM' THEN '/docs' ELSE '/chat' END AS path
      FROM orders))""")
def j6(spark, sf):
    paths = {"1-URGENT": "/health", "2-HIGH": "/admin/users", "3-MEDIUM": "/docs"}
    requests = t(spark, sf, "orders").select(
        "o_orderkey", F.lit("GET").alias("method"), s.cases("o_orderpriority", paths, "/chat").alias("path"),
        s.cases("o_orderstatus", {"P": 404}, 200).alias("status"), F.floor(F.col("o_totalprice") / 100).alias("duration_ms"))
    return lg.classify_requests(requests).select("o_orderkey", "severity", "message")


@query("j7_trace_summaries", sql("timed_events", body="""
  SELECT trace_id, count(*) AS n_events, count(*) FILTER (severity = 'error') AS n_errors, min(ts) AS first_ts, max(ts) AS last_ts,
         arg_min(event_type, ts) AS first_event, arg_max(event_type, ts) AS last_event,
         date_diff('microsecond', min(ts), max(ts)) // 1000 AS span_ms FROM timed_events GROUP BY trace_id"""))
def j7a(spark, sf):
    return lg.trace_summaries(s.timed_events(spark, sf))


@query("j7_trace_events", sql("timed_events", body="""
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, ord) AS place FROM timed_events"""))
def j7b(spark, sf):
    return lg.trace_events(s.timed_events(spark, sf))


@query("j7_events_without_trace", sql("timed_events", body="""
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts NULLS FIRST, ord) AS place FROM (
    SELECT * REPLACE (CASE WHEN ord % 3 > 0 THEN trace_id END AS trace_id, CASE WHEN ord % 7 > 0 THEN ts END AS ts) FROM timed_events)"""))
def j7c(spark, sf):
    """Events without a trace are a group of their own; those without a time come first."""
    events = s.timed_events(spark, sf).withColumn("trace_id", F.when(F.col("ord") % 3 > 0, F.col("trace_id")))
    return lg.trace_events(events.withColumn("ts", F.when(F.col("ord") % 7 > 0, F.col("ts"))))


@query("j8_latency_breakdown", """
  SELECT step, count(*) AS n, round(avg(ms), 3) AS mean_ms, round(quantile_cont(ms, 0.5), 3) AS median_ms,
         round(quantile_cont(ms, 0.95), 3) AS p95_ms, max(ms) AS max_ms FROM (
    SELECT 'embed_ms' AS step, value AS ms FROM events UNION ALL
    SELECT 'search_ms', (props->>'k')::DOUBLE FROM events UNION ALL
    SELECT 'total_ms', event_id::DOUBLE FROM events) GROUP BY step""")
def j8(spark, sf):
    details = F.concat(F.lit('{"timing":{"embed_ms":'), F.col("value").cast("string"), F.lit(',"search_ms":'),
                       F.get_json_object("props", "$.k"), F.lit(',"total_ms":'), F.col("event_id").cast("string"), F.lit("}}"))
    return lg.latency_breakdown(t(spark, sf, "events").select(details.alias("details")))


@query("j9_web_search_rates", """
  SELECT CASE WHEN event_type IN ('error', 'signup') THEN event_type END AS block_reason, count(*) AS searches,
         count(*) FILTER (event_type IN ('error', 'signup')) AS blocked, sum(floor(value))::BIGINT AS results FROM events GROUP BY 1""")
def j9(spark, sf):
    blocked = F.col("event_type").isin("error", "signup")
    log = t(spark, sf, "events").select(blocked.alias("was_blocked"), F.when(blocked, F.col("event_type")).alias("block_reason"),
                                        F.floor("value").alias("results_count"))
    return lg.web_search_rates(log)
