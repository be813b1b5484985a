"""Stage logs, timed operations, traces and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as fv
from leafmill.functions.ordered import nearest_in_order, number_within, quantiles



def millis(start: Column, end: Column) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / 1000).cast("long")


def close_stages(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Stage rows folded from running / success / failed events.

    `events` needs ord, doc_id, stage, status, ts, error. An end closes the
    newest start that is still open; without one it makes a closed row of its
    own. Starts never closed stay `running`.

    Ends and starts pair like brackets: counting +1 and -1 along the group, a
    start is closed by the next end at its level. An end at level 0 has no start.
    """
    keys = ["doc_id", "stage"]
    day = F.to_date("ts") if bucket is None else bucket
    start = F.col("status") == "running"
    work = events.withColumn("_day", day).withColumn("_start", start)
    # Depth before each event, floored at zero: running sum minus its running minimum.
    work = _running_depth(work, keys)
    level = F.when(F.col("_start"), F.col("_depth") + 1).otherwise(F.col("_depth"))
    work = work.withColumn("_level", level)
    end = F.when(~F.col("_start"), F.struct("ts", "status", "error"))
    paired = nearest_in_order(work.filter("_level > 0"), keys + ["_level"], ["ts", "ord"], "_day", end, after="_end")
    closed = paired.filter("_start").select(
        *keys, "ord", F.col("ts").alias("started_at"), F.coalesce("_end.status", "status").alias("status"),
        F.col("_end.ts").alias("finished_at"), F.coalesce("_end.error", "error").alias("error"))
    lone = work.filter("_level = 0").select(
        *keys, "ord", F.col("ts").alias("started_at"), "status", F.col("ts").alias("finished_at"), "error")
    return closed.unionByName(lone)


def _running_depth(work: DataFrame, keys: list[str]) -> DataFrame:
    """Open starts before each event, per group, worked out day by day.

    A day changes the depth d to max(d + net, net - low): `net` is its sum of
    steps and `low` the lowest running sum. Those two numbers per day are all
    that crosses from one day to the next.
    """
    work = work.withColumn("_cell", F.struct(*keys, "_day"))  # never null, so rows with null keys stay
    step = F.when(F.col("_start"), 1).otherwise(-1)
    inside = Window.partitionBy("_cell").orderBy("ts", "ord")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("_sum", F.sum(step).over(upto))
    work = work.withColumn("_low", F.least(F.min("_sum").over(upto), F.lit(0)))
    days = work.groupBy("_cell").agg(F.max_by("_sum", F.struct("ts", "ord")).alias("net"), F.min("_low").alias("low"))
    before = Window.partitionBy(*[f"_cell.{k}" for k in keys]).orderBy("_cell._day")
    along = before.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("_total", F.sum("net").over(along))
    days = days.withColumn("_floor", F.least(F.min(F.col("_total") - F.col("net") + F.col("low")).over(along), F.lit(0)))
    carried = days.select("_cell", F.coalesce(F.lag(F.col("_total") - F.col("_floor")).over(before), F.lit(0)).alias("_carry"))
    work = work.join(carried, "_cell")
    prior_sum = F.col("_sum") - step
    prior_low = F.least(F.coalesce(F.lag("_low").over(inside), F.lit(0)), F.lit(0))
    depth = prior_sum + F.col("_carry") - F.least(prior_low + F.col("_carry"), F.lit(0))
    return work.withColumn("_depth", depth.cast("long")).drop("_sum", "_low", "_carry", "_cell")


def document_states(documents: DataFrame, stages: DataFrame, as_of) -> DataFrame:
    """Documents with the status their newest stage rows imply.

    failed if the newest row of any stage failed, processing while one runs,
    indexed once stages ended without failure; untouched without any row.
    """
    newest = stages.groupBy("doc_id", "stage").agg(
        F.max_by(F.struct("status", "error", "finished_at"), F.struct("started_at", "ord")).alias("s"))
    seen = newest.groupBy("doc_id").agg(
        F.count_if(F.col("s.status") == "failed").alias("n_failed"),
        F.count_if(F.col("s.status") == "running").alias("n_running"),
        F.min(F.when(F.col("s.status") == "failed", F.struct("stage", F.substring("s.error", 1, 1000).alias("e")))).alias("why"))
    status = (F.when(F.col("n_failed").isNull(), F.col("status")).when(F.col("n_failed") > 0, "failed")
              .when(F.col("n_running") > 0, "processing").otherwise("indexed"))
    return (documents.join(seen, "doc_id", "left")
            .withColumn("error_msg", F.when(F.col("n_failed").isNull(), F.col("error_msg")).otherwise(F.col("why.e")))
            .withColumn("updated_at", F.when(F.col("n_failed").isNull(), F.col("updated_at")).otherwise(F.lit(as_of)))
            .withColumn("status", status).drop("n_failed", "n_running", "why"))


def stage_counts(documents: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Per document the counts a finished run records, as JSON."""
    rows = documents.select("doc_id")
    for name, part in parts.items():
        rows = rows.join(part.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    counts = F.struct(*[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in parts])
    return rows.select("doc_id", F.to_json(counts).alias("metadata"))


def status_timeline(documents: DataFrame, logs: DataFrame) -> DataFrame:
    """Every stage row of every document; `place` 1 is the newest.

    Rows are numbered day by day, so a document with very many rows is not one task.
    Rows without a start time come last.
    """
    back = -F.datediff(F.to_date("started_at"), F.lit("1970-01-01"))
    work = logs.withColumn("_back_day", F.coalesce(back, F.lit(2**31 - 1)))
    numbered = number_within(work, ["doc_id"], [F.desc("started_at"), F.desc("id")], "_back_day", "place")
    names = documents.select("doc_id", F.col("status").alias("doc_status"))
    return numbered.withColumn("place", F.col("place") + 1).drop("_back_day").join(names, "doc_id")


def timed_pairs(events: DataFrame) -> DataFrame:
    """Each stage end or failure with the latest start before it in its (trace, stage).

    `events` needs ord, trace_id, stage, event_type, ts.
    """
    start = F.when(F.col("event_type") == "stage_start", F.struct("ord", "ts"))
    work = nearest_in_order(events.withColumn("_day", F.to_date("ts")), ["trace_id", "stage"], ["ts", "ord"], "_day", start, before="_from")
    ends = work.filter(F.col("event_type").isin("stage_end", "stage_fail") & F.col("_from").isNotNull())
    return ends.select("trace_id", "stage", F.col("_from.ord").alias("start_ord"), F.col("ord").alias("end_ord"), "event_type",
                       F.col("_from.ts").alias("started_at"), F.col("ts").alias("ended_at"),
                       millis(F.col("_from.ts"), F.col("ts")).alias("duration_ms"))


def classify_requests(requests: DataFrame) -> DataFrame:
    """What the request log keeps: slow ones, then error statuses; some paths never.

    Needs method, path, status, duration_ms. A null `severity` is not logged.
    """
    skipped = F.col("path").isin(fv.UNLOGGED_PATHS) | F.col("path").startswith("/admin/")
    line = F.concat_ws(" ", "method", "path", F.lit("→"), F.col("status").cast("string"))
    slow, bad = F.col("duration_ms") > fv.SLOW_REQUEST_MS, F.col("status") >= 400
    return (requests.withColumn("severity", F.when(skipped, F.lit(None)).when(slow | bad, "warning"))
            .withColumn("message", F.when(skipped, F.lit(None).cast("string")).when(slow, F.concat(F.lit("Slow request: "), line)).when(bad, line)))


def trace_summaries(events: DataFrame) -> DataFrame:
    """Per trace: first and last event, count, errors, and its span."""
    place = F.struct("ts", "ord")
    seen = events.groupBy("trace_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("event_type", place).alias("first_event"), F.max_by("event_type", place).alias("last_event"))
    return seen.withColumn("span_ms", millis(F.col("first_ts"), F.col("last_ts")))


def trace_events(events: DataFrame) -> DataFrame:
    """Every event with its 1-based place in its trace, numbered day by day."""
    work = events.withColumn("_day", F.to_date("ts"))
    numbered = number_within(work, ["trace_id"], ["ts", "ord"], "_day", "place")
    return numbered.withColumn("place", F.col("place") + 1).drop("_day")


TIMING = "timing struct<embed_ms:double,search_ms:double,rerank_ms:double,graph_ms:double,web_ms:double,total_ms:double>"


def latency_breakdown(events: DataFrame) -> DataFrame:
    """Mean, median, 95th percentile and largest time per step of answered queries, from their JSON details."""
    timing = F.from_json("details", TIMING)["timing"]
    steps = ["embed_ms", "search_ms", "rerank_ms", "graph_ms", "web_ms", "total_ms"]
    long = events.select(timing.alias("t")).filter(F.col("t").isNotNull()).select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("step"), F.col(f"t.{s}").alias("ms")) for s in steps])).alias("x")).select("x.*")
    measured = long.filter("ms IS NOT NULL")
    means = measured.groupBy("step").agg(F.round(F.avg("ms"), 3).alias("mean_ms"), F.max("ms").alias("max_ms"))
    spread = quantiles(measured, ["step"], "ms", {"median_ms": 0.5, "p95_ms": 0.95})
    return means.join(spread, "step").select(
        "step", "n", "mean_ms", F.round("median_ms", 3).alias("median_ms"), F.round("p95_ms", 3).alias("p95_ms"), "max_ms")


def web_search_rates(log: DataFrame) -> DataFrame:
    """Searches, blocked ones and results by block reason."""
    return log.groupBy("block_reason").agg(
        F.count("*").alias("searches"), F.count_if("was_blocked").alias("blocked"),
        F.sum("results_count").cast("long").alias("results"))


def log_rows(events: DataFrame) -> DataFrame:
    """Events as stored: message, error and traceback cut to length, details as JSON.

    Needs message, error_type, error_message, traceback (the end of it is kept). The
    caller's own `details`, a JSON object, may come with it: an error's fields join it.
    """
    error = F.struct("error_type", F.substring("error_message", 1, 1000).alias("error_message"),
                     F.right("traceback", F.lit(2000)).alias("traceback"))
    found = F.when(F.col("error_type").isNotNull(), F.to_json(error))
    rest = [c for c in events.columns if c not in ("message", "error_type", "error_message", "traceback", "details")]
    if "details" in events.columns:
        own = F.trim("details")
        body = F.trim(own.substr(F.lit(2), F.greatest(F.length(own) - 2, F.lit(0))))
        joined = F.concat(F.lit("{"), body, F.lit(","), found.substr(F.lit(2), F.length(found)))
        found = F.when(found.isNull(), F.col("details")).when(own.isNull() | (body == ""), found).otherwise(joined)
    return events.select(*rest, F.substring("message", 1, 2000).alias("message"), found.alias("details"))
