"""Streaming jobs and their batch forms (K)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import part, query, sql
from checks.standins import t
from checks.wording import ranked, sql_keywords, sql_pieces
from leafmill.session import shared_dir
from leafmill.streaming import jobs as jb


def stamped(df, column="ts"):
    return df.withColumn(column, F.col(column).cast("timestamp"))


def ntz(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def event_stream(spark, sf):
    return jb.event_stream(spark, sf, "events.parquet", t(spark, sf, "events").schema)


def through_stream(df):
    """Run a stream over what there is, into a fresh folder of the shared directory."""
    folder = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    return jb.run_to_table(df, f"{folder}/out", f"{folder}/progress")


# --- K1 ---------------------------------------------------------------------------

def files(spark, sf):
    return s.parsed(spark, sf).withColumn("path", F.format_string("/%s/%d.json", "lang", "doc_id"))


INGESTED = """
  SELECT doc_id, '/' || lang || '/' || doc_id || '.json' AS path, sha256(text) AS hash, 'pending' AS status FROM documents
  QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY '/' || lang || '/' || doc_id || '.json') = 1"""


@query("k1_ingest_documents", INGESTED)
def k1(spark, sf):
    return jb.ingest_tables(jb.new_documents(files(spark, sf), None), settle=lambda table: table)["documents"]


@query("k1_streamed_ingest", INGESTED)
def k1b(spark, sf):
    folder = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    files(spark, sf).drop("lang").write.option("compression", "gzip").json(f"{folder}/in")
    jb.ingest_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/out/documents").drop("batch")


def two_batches(spark, sf):
    """All files, then those of every third document with other text under the same path: the folder of the tables."""
    folder = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    first = files(spark, sf).drop("lang")
    line = F.array(F.struct(F.lit(1).alias("page_num"), F.concat(F.lit("second reading of "), F.col("doc_id").cast("string")).alias("text")))
    later = first.filter("doc_id % 3 = 0").withColumn("pages", line).withColumn("markdown", F.col("pages")[0]["text"]).drop("images")
    for rows in (first, later):
        rows.write.mode("append").option("compression", "gzip").json(f"{folder}/in")
        jb.ingest_stream(spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress").awaitTermination()
    return f"{folder}/out"


part("second_reading", f"""
  SELECT doc_id, path, CASE WHEN doc_id % 3 = 0 THEN sha256('second reading of ' || doc_id) ELSE hash END AS hash FROM ({INGESTED})""")
# after the first batch only files that were read then are known by path; a skipped copy has an unknown path, and its text is new
part("later_files", f"""
  SELECT doc_id, '/' || lang || '/' || doc_id || '.json' AS path, sha256('second reading of ' || doc_id) AS hash FROM documents
  WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM ({INGESTED}))""")


@query("k1_two_batches_documents", sql("second_reading", "later_files", body="""
  SELECT *, 'pending' AS status FROM (SELECT * FROM second_reading UNION ALL SELECT * FROM later_files)"""))
def k1c(spark, sf):
    return jb.current_rows(spark, two_batches(spark, sf), "documents")


@query("k1_two_batches_blocks", sql("second_reading", "later_files", "parsed_blocks", body="""
  SELECT doc_id, block_idx, block_type, source_text, page_number FROM parsed_blocks WHERE doc_id IN (SELECT doc_id FROM second_reading WHERE doc_id % 3 > 0)
  UNION ALL
  SELECT doc_id, 0, 'text', 'second reading of ' || doc_id, 1 FROM (SELECT doc_id FROM second_reading UNION ALL SELECT doc_id FROM later_files) WHERE doc_id % 3 = 0"""))
def k1d(spark, sf):
    rows = jb.current_rows(spark, two_batches(spark, sf), "blocks").select("doc_id", "block_idx", "block_type", "source_text", "page_number")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("block_idx", "page_number")})


# all chunks there are after both batches: of unchanged documents those of their blocks, of the others their new line
part("first_chunks", sql_pieces("(SELECT doc_id, block_type AS chunk_type, block_idx, page_number, source_text FROM (SELECT * EXCLUDE (source_text), "
                                + s.sql_strip("source_text") + " AS source_text FROM parsed_blocks))", "doc_id, chunk_type, page_number", "source_text", "block_idx", 512, 50), "parsed_blocks")
part("ingested_chunks", f"""
  SELECT doc_id * 16777216 + chunk_idx AS chunk_id, doc_id, chunk_idx, chunk_type, content, token_cnt FROM (
    SELECT doc_id, chunk_idx, chunk_type, content, token_cnt FROM first_chunks WHERE doc_id IN (SELECT doc_id FROM second_reading WHERE doc_id % 3 > 0)
    UNION ALL
    SELECT doc_id, 0, 'text', line, {s.sql_tokens('line')} FROM (SELECT doc_id, 'second reading of ' || doc_id AS line FROM (
      SELECT doc_id FROM second_reading UNION ALL SELECT doc_id FROM later_files) WHERE doc_id % 3 = 0))""", "first_chunks", "second_reading", "later_files")
part("ingested_normal", f"SELECT chunk_id, {s.sql_norm('content')} AS normal FROM ingested_chunks", "ingested_chunks")


@query("k1_two_batches_chunks", sql("ingested_chunks", body="SELECT * FROM ingested_chunks"))
def k1e(spark, sf):
    rows = jb.current_rows(spark, two_batches(spark, sf), "chunks").select("chunk_id", "doc_id", "chunk_idx", "chunk_type", "content", "token_cnt")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("chunk_idx", "token_cnt")})


@query("k1_two_batches_keywords", sql("ingested_chunks", "ingested_normal", "ranked_builtin", body=sql_keywords(
    "ingested_chunks", "chunk_id", "content", "ranked_builtin").replace("normal JOIN", "ingested_normal JOIN")))
def k1f(spark, sf):
    """All keywords after both batches; of a changed document only those of its new line are left."""
    return ranked(jb.current_rows(spark, two_batches(spark, sf), "keywords").drop("doc_id"))


# --- K2 ---------------------------------------------------------------------------

def sql_windows(size_days: int) -> str:
    """Days, or windows of two days that start every day."""
    shift = "ts::DATE::TIMESTAMP" if size_days == 1 else "ts::DATE::TIMESTAMP - to_days(unnest([0, 1]))"
    return f"""
  SELECT window_start, window_start + INTERVAL {size_days} DAY AS window_end, module, count(*) AS total_events,
         count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
         round(nullif(avg(duration_ms), 0), 1) AS avg_duration_ms
  FROM (SELECT *, {shift} AS window_start FROM (SELECT *, created_at AS ts FROM event_logs)) GROUP BY ALL"""


def module_events(events):
    severity = F.when(F.col("value") > 150, "error").when(F.col("value") > 80, "warning").otherwise("info")
    return stamped(events).select("ts", s.cases("event_type", s.MODULE).alias("module"), severity.alias("severity"),
                                  F.when(F.col("value") >= 5, F.col("value")).alias("duration_ms"))


@query("k2_module_windows", sql("event_logs", body=sql_windows(1)))
def k2a(spark, sf):
    return ntz(jb.windowed_module_stats(module_events(t(spark, sf, "events"))), "window_start", "window_end")


@query("k2_sliding_module_windows", sql("event_logs", body=sql_windows(2)))
def k2b(spark, sf):
    return ntz(jb.windowed_module_stats(module_events(t(spark, sf, "events")), "2 days", "1 day"), "window_start", "window_end")


# a stream gives out a window once the watermark, an hour behind the latest event, has passed it
@query("k2_streamed_module_windows", sql("event_logs", body=f"""
  SELECT * FROM ({sql_windows(1)}) WHERE window_end <= (SELECT max(created_at) FROM event_logs) - INTERVAL 1 HOUR"""))
def k2c(spark, sf):
    rows = through_stream(jb.windowed_module_stats(module_events(event_stream(spark, sf))))
    return ntz(rows, "window_start", "window_end")


# --- K3 ---------------------------------------------------------------------------

def halves(events):
    """Views are starts of a visitor's stage, purchases are ends."""
    rows = stamped(events).select(F.col("user_id").alias("trace_id"), F.lit("order").alias("stage"), "ts", F.col("event_id").alias("ord"), "event_type")
    return rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'")


STAGES = """
  SELECT v.user_id AS trace_id, 'order' AS stage, v.ts AS started_at, v.event_id AS start_ord, p.ts AS ended_at, p.event_id AS end_ord, p.event_type AS outcome
  FROM events v {how} JOIN events p ON p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 DAY
  WHERE v.event_type = 'view' QUALIFY row_number() OVER (PARTITION BY v.event_id ORDER BY p.ts, p.event_id) = 1"""


@query("k3_stage_durations", STAGES.format(how="LEFT"))
def k3a(spark, sf):
    return ntz(jb.stage_durations(*halves(t(spark, sf, "events"))), "started_at", "ended_at")


@query("k3_streamed_stage_durations", STAGES.format(how="INNER"))
def k3b(spark, sf):
    """The stages that ended, of all that the stream has written."""
    return k3c(spark, sf).filter("ended_at IS NOT NULL")


# a start without an end comes out once the watermark, an hour behind the latest row of the slower side, has passed its day
@query("k3_streamed_open_stages", f"""
  SELECT * FROM ({STAGES.format(how="LEFT")}) WHERE ended_at IS NOT NULL OR started_at + INTERVAL 1 DAY < (
    SELECT least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase')) FROM events) - INTERVAL 1 HOUR""")
def k3c(spark, sf):
    """The first end of each start, and the starts that the watermark has passed without one, from what the stream has written."""
    starts, _ = halves(event_stream(spark, sf))
    _, ends = halves(event_stream(spark, sf))
    return ntz(jb.nearest_ends(through_stream(jb.stage_pairs(starts, ends))), "started_at", "ended_at")


# --- K4 ---------------------------------------------------------------------------

part("attempts", """SELECT user_id, ts, event_id AS ord, event_type IN ('click', 'purchase') AS success,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events""")
part("first_fold", """SELECT *, CASE WHEN success THEN 0 ELSE 1 END AS failures, NULL::TIMESTAMP AS locked_until,
  CASE WHEN success THEN 'success' ELSE 'failure' END AS outcome FROM attempts WHERE i = 1""", "attempts")
part("fold", """RECURSIVE
  SELECT user_id, ts, ord, i, outcome, failures::BIGINT AS failures, locked_until FROM first_fold
  UNION ALL
  SELECT user_id, ts, ord, i,
    CASE WHEN locked THEN 'rejected' WHEN success THEN 'success' WHEN failures + 1 >= 3 THEN 'locked' ELSE 'failure' END,
    CASE WHEN locked THEN failures WHEN success THEN 0 ELSE failures + 1 END,
    CASE WHEN NOT locked AND NOT success AND failures + 1 >= 3 THEN ts + INTERVAL 720 MINUTE ELSE locked_until END
  FROM (SELECT a.user_id, a.ts, a.ord, a.i, a.success, f.failures, f.locked_until, coalesce(f.locked_until > a.ts, false) AS locked
        FROM fold f JOIN attempts a ON a.user_id = f.user_id AND a.i = f.i + 1)""", "attempts", "first_fold")
FOLD = sql("fold", body="SELECT user_id, ts, ord, outcome, failures, locked_until FROM fold")


def attempts(events):
    return stamped(events).select("user_id", "ts", F.col("event_id").alias("ord"), F.col("event_type").isin("click", "purchase").alias("success"))


def sign_ins(df):
    return ntz(df.withColumn("failures", F.col("failures").cast("long")), "ts", "locked_until")


@query("k4_lockouts", FOLD)
def k4a(spark, sf):
    return sign_ins(jb.lockouts(attempts(t(spark, sf, "events")), 3, 720))


@query("k4_streamed_lockouts", FOLD)
def k4b(spark, sf):
    return sign_ins(through_stream(jb.lockout_stream(attempts(event_stream(spark, sf)), 3, 720)))
