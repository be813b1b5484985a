"""Operational reports over document, query, event, stage, sync and audit tables.

Times are compared with an `as_of` the caller passes, so a report can be run
again with the same result.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions.ordered import top_k



def since(column: str, as_of: datetime.datetime, **span: int) -> Column:
    return F.col(column) >= F.lit(as_of - datetime.timedelta(**span))


def page_of(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a listing; `order` must be total for the page to be well defined."""
    return df.orderBy(*order).offset(offset).limit(limit)


def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows equal to every given value; None means not filtered."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def _number(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")


# --- documents --------------------------------------------------------------

def status_totals(documents: DataFrame) -> DataFrame:
    status = F.col("status")
    return documents.agg(
        F.count("*").alias("total"), F.count_if(status == "indexed").alias("indexed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status.isin("pending", "processing")).alias("pending"))


def document_base(documents: DataFrame, departments: DataFrame, roles: DataFrame, folders: DataFrame,
                  parts: dict[str, DataFrame]) -> DataFrame:
    """Documents with department, role and folder names and a count per part table.

    Every part is counted before it meets the documents, so no join multiplies rows.
    Counts come first: all their joins share one shuffle on the document, and names,
    whose keys have few values, then join rows that are spread by document.
    """
    rows = documents
    for name, part in parts.items():
        counts = part.groupBy("doc_id").agg(F.count("*").alias(f"{name}_count"))
        rows = rows.join(counts, "doc_id", "left").withColumn(f"{name}_count", _number(F.col(f"{name}_count")))
    for table, key, label in ((departments, "dept_id", "dept_name"), (roles, "role_id", "role_name"), (folders, "folder_id", "folder_name")):
        rows = rows.join(table.select(key, label), key, "left")
    return rows


def document_list(base: DataFrame, status: str | None = None, search: str | None = None,
                  limit: int = 50, offset: int = 0) -> DataFrame:
    rows = equal_filters(base, status=status)
    if search:
        rows = rows.filter(tx.matches_search(search, F.col("file_name"), F.col("path"), F.col("type")))
    return page_of(rows, [F.desc("updated_at"), F.desc("doc_id")], limit, offset)


def document_logs(documents: DataFrame, logs: DataFrame, wanted: DataFrame, keep: int = 10) -> DataFrame:
    """The latest stage rows of each wanted document."""
    mine = logs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    best = top_k(mine, ["doc_id"], [F.desc("started_at"), F.desc("id")], keep)
    return best.join(documents.select("doc_id", "file_name"), "doc_id", "left")


def document_blocks(blocks: DataFrame, wanted: DataFrame | None = None, block_type: str | None = None,
                    keep: int = 24) -> DataFrame:
    """The first blocks of each wanted document, with a preview of the text."""
    if wanted is not None:
        blocks = blocks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    best = top_k(equal_filters(blocks, block_type=block_type), ["doc_id"], [F.asc("block_idx")], keep)
    return best.withColumn("preview_text", tx.preview(F.col("source_text")))


def count_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def indexed_by_department(documents: DataFrame, departments: DataFrame) -> DataFrame:
    counts = documents.filter("status = 'indexed'").groupBy("dept_id").agg(F.count("*").alias("n"))
    return counts.join(departments.select("dept_id", F.col("dept_name").alias("department")), "dept_id").groupBy(
        "department").agg(F.sum("n").alias("n_docs"))


def document_stats(documents: DataFrame, departments: DataFrame, roles: DataFrame, folders: DataFrame,
                   chunks: DataFrame) -> DataFrame:
    """Chunk count per document; a document without department or role is left out."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return (documents.join(departments.select("dept_id", F.col("dept_name").alias("department")), "dept_id")
            .join(roles.select("role_id", "role_name"), "role_id")
            .join(folders.select("folder_id", "folder_name"), "folder_id", "left")
            .join(counts, "doc_id", "left").withColumn("chunk_count", _number(F.col("chunk_count"))))


def distinct_part_counts(documents: DataFrame, parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct part ids per document; each part is counted on its own, then joined."""
    rows = documents
    for name, (part, key) in parts.items():
        counts = part.groupBy("doc_id").agg(F.countDistinct(key).alias(f"{name}_count"))
        rows = rows.join(counts, "doc_id", "left").withColumn(f"{name}_count", _number(F.col(f"{name}_count")))
    return rows


# --- queries and users ------------------------------------------------------

def active_users(queries: DataFrame, as_of: datetime.datetime, days: int = 7) -> DataFrame:
    return queries.filter(since("created_at", as_of, days=days)).agg(F.countDistinct("user_id").alias("active_users"))


def recent_queries(queries: DataFrame, as_of: datetime.datetime, days: int = 7) -> DataFrame:
    return queries.filter(since("created_at", as_of, days=days)).agg(F.count("*").alias("queries"))


def daily_stats(queries: DataFrame, as_of: datetime.datetime, days: int = 30) -> DataFrame:
    """Count and mean latency per day; a mean of 0 is shown as missing."""
    return (queries.filter(since("created_at", as_of, days=days))
            .groupBy(F.to_date("created_at").alias("date"))
            .agg(F.count("*").alias("query_count"),
                 F.round(F.nullif(F.avg("latency_ms"), F.lit(0.0)), 1).alias("avg_latency_ms")))


def dashboard_totals(daily: DataFrame, by_status: DataFrame) -> DataFrame:
    """Totals over the daily rows and over the status counts; one row each, side by side."""
    days = daily.agg(F.sum("query_count").alias("total_queries"),
                     F.round(F.avg("avg_latency_ms"), 0).alias("avg_latency_ms"))
    files = by_status.agg(F.sum("n").alias("total_docs"),
                          F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("n"))), F.lit(0)).alias("indexed_docs"))
    return days.select("*", *[files.select(c).scalar().alias(c) for c in files.columns])


def top_users(queries: DataFrame, users: DataFrame, limit: int = 10) -> DataFrame:
    counts = queries.groupBy("user_id").agg(F.count("*").alias("query_count"))
    best = counts.orderBy(F.desc("query_count"), F.asc_nulls_last("user_id")).limit(limit)
    return best.join(users.select("user_id", "usr_name"), "user_id", "left").withColumn(
        "usr_name", F.coalesce("usr_name", F.lit("Unknown")))


def query_log_list(queries: DataFrame, user_id: int | None = None, date_from: datetime.datetime | None = None,
                   date_to: datetime.datetime | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the query log. A bare end date stands for its midnight, so that day is out."""
    rows = equal_filters(queries, user_id=user_id)
    if date_from is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(date_from))
    if date_to is not None:
        rows = rows.filter(F.col("created_at") <= F.lit(date_to))
    return page_of(rows.withColumn("prompt", F.substring("prompt", 1, 200)),
                   [F.desc("created_at"), F.desc("id")], limit, offset)


def user_list(users: DataFrame, roles: DataFrame, departments: DataFrame, how: str = "left") -> DataFrame:
    return (users.join(roles.select("role_id", "role_name"), "role_id", how)
            .join(departments.select("dept_id", "dept_name"), "dept_id", how))


def user_activity(users: DataFrame, departments: DataFrame, roles: DataFrame, audit: DataFrame,
                  action: str = "query") -> DataFrame:
    """Actions per user, how many are `action`, and the latest; counted before the join."""
    seen = audit.groupBy("user_id").agg(
        F.count("*").alias("total_actions"), F.count_if(F.col("action_type") == action).alias("total_queries"),
        F.max("created_at").alias("last_activity"))
    rows = user_list(users, roles, departments, how="inner").join(seen, "user_id", "left")
    return rows.select("user_id", "usr_name", F.col("dept_name").alias("department"), "role_name",
                       _number(F.col("total_actions")).alias("total_actions"),
                       _number(F.col("total_queries")).alias("total_queries"), "last_activity")


# --- stages, events, syncs --------------------------------------------------

def running_stages(logs: DataFrame) -> DataFrame:
    """(document, stage) pairs whose newest row is running and not finished."""
    newest = logs.groupBy("doc_id", "stage").agg(
        F.max(F.struct("id", "status", "finished_at")).alias("last"))
    return newest.filter((F.col("last.status") == "running") & F.col("last.finished_at").isNull()).select(
        "doc_id", "stage", F.col("last.id").alias("id"))


def recent_errors(events: DataFrame, as_of: datetime.datetime, hours: int = 24) -> DataFrame:
    return events.filter((F.col("severity") == "error") & since("created_at", as_of, hours=hours)).agg(
        F.count("*").alias("errors"))


def latest_failures(logs: DataFrame, documents: DataFrame, limit: int = 5, how: str = "left") -> DataFrame:
    """The latest failed stage rows with the file name. With `inner`, only of known documents."""
    failed = logs.filter("status = 'failed'")
    order = [F.desc("started_at"), F.desc("id")]
    names = documents.select("doc_id", "file_name")
    if how == "left":  # the join drops nothing, so only the page needs names
        return failed.orderBy(*order).limit(limit).join(names, "doc_id", "left")
    return failed.join(names, "doc_id", how).orderBy(*order).limit(limit)


def latest_syncs(syncs: DataFrame, limit: int = 5) -> DataFrame:
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("files_added", "files_modified", "files_deleted")]
    page = syncs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)
    return page.select(*[c for c in page.columns if not c.startswith("files_")], *zero)


def system_summary(documents: DataFrame, queries: DataFrame, logs: DataFrame, events: DataFrame,
                   syncs: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """One row: status totals, activity, running stages, errors, failures and syncs shown."""
    shown = latest_failures(logs, documents).agg(F.count("*").alias("n"))
    synced = latest_syncs(syncs).agg(F.count("*").alias("n"))
    return status_totals(documents).select(
        "*",
        active_users(queries, as_of).scalar().alias("active_users_7d"),
        recent_queries(queries, as_of).scalar().alias("queries_7d"),
        running_stages(logs).agg(F.count("*")).scalar().alias("running_stages"),
        recent_errors(events, as_of).scalar().alias("event_errors_24h"),
        shown.scalar().alias("recent_failures"), synced.scalar().alias("recent_syncs"))


def health_score(summary: DataFrame) -> DataFrame:
    score = 100 - F.col("recent_failures") * 10 - F.col("event_errors_24h") * 5 - F.col("failed") * 2
    return summary.withColumn("health_score", F.greatest(F.lit(25), score))


def module_stats(events: DataFrame, as_of: datetime.datetime, days: int = 7) -> DataFrame:
    recent = events.filter(since("created_at", as_of, days=days))
    return recent.groupBy("module").agg(*module_measures())


def module_measures() -> list[Column]:
    severity = F.col("severity")
    return [F.count("*").alias("total_events"), F.count_if(severity == "error").alias("errors"),
            F.count_if(severity == "warning").alias("warnings"),
            F.round(F.nullif(F.avg("duration_ms"), F.lit(0.0)), 1).alias("avg_duration_ms")]


def stage_log_list(logs: DataFrame, documents: DataFrame, status: str | None = None, stage: str | None = None,
                   limit: int = 50, offset: int = 0) -> DataFrame:
    page = page_of(equal_filters(logs, status=status, stage=stage),
                   [F.desc("started_at"), F.desc("id")], limit, offset)
    return page.join(documents.select("doc_id", "file_name"), "doc_id", "left")


def event_log_list(events: DataFrame, limit: int = 50, offset: int = 0, **wanted) -> DataFrame:
    """A page of events; filters: module, event_type, severity, trace_id, doc_id, user_id."""
    return page_of(equal_filters(events, **wanted), [F.desc("created_at"), F.desc("id")], limit, offset)


def sync_history(syncs: DataFrame, limit: int = 100) -> DataFrame:
    """The latest syncs with their changes, for a chart over start time."""
    return syncs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit).withColumn(
        "files_changed", F.coalesce("files_added", F.lit(0)) + F.coalesce("files_modified", F.lit(0))
        + F.coalesce("files_deleted", F.lit(0)))
