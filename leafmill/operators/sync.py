"""Snapshot comparison, upserts and integrity checks."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import fixed_values as fv
from leafmill.session import cut_lineage


def classify_changes(scan: DataFrame, documents: DataFrame, exclude_failed: bool = False) -> DataFrame:
    """Scan and documents side by side with change: added, modified, deleted, moved, repeated or same.

    One full join on path. A new path is added only if its content is unknown;
    with known content it is `moved`, and among equal new files the smallest
    path is added and the others are `repeated`.
    """
    base = documents.filter("status <> 'failed'") if exclude_failed else documents
    old = base.select("path", "doc_id", F.col("hash").alias("old_hash"))
    both = scan.withColumn("_seen", F.lit(True)).join(old, "path", "full")
    new = both.filter(F.col("doc_id").isNull())
    first = new.groupBy("hash").agg(F.min("path").alias("_first"))
    known = base.select("hash").distinct().withColumn("_known", F.lit(True))
    fresh = (new.join(first, "hash", "left").join(known, "hash", "left")
             .withColumn("change", F.when(F.col("_known"), "moved")
                         .when(F.col("path") == F.col("_first"), "added").otherwise("repeated"))
             .drop("_first", "_known"))
    rest = both.filter(F.col("doc_id").isNotNull()).withColumn(
        "change", F.when(F.col("_seen").isNull(), "deleted")
        .when(F.col("hash") != F.col("old_hash"), "modified").otherwise("same"))
    return rest.unionByName(fresh).drop("_seen")


def apply_changes(changes: DataFrame, documents: DataFrame, as_of: datetime.datetime,
                  dept_id: int = 1, role_id: int = 3) -> DataFrame:
    """The document table after a sync. New rows have no doc_id yet."""
    at = F.lit(as_of)
    seen = changes.filter("doc_id IS NOT NULL").select(
        "doc_id", "change", F.col("hash").alias("new_hash"), F.col("size").alias("new_size"))
    modified, deleted = F.col("change") == "modified", F.col("change") == "deleted"
    kept = documents.join(seen, "doc_id", "left")
    updated = kept.select(
        *[c for c in documents.columns if c not in ("hash", "size", "status", "error_msg", "updated_at")],
        F.when(modified, F.col("new_hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(modified, F.col("new_size")).otherwise(F.col("size")).alias("size"),
        F.when(modified, "pending").when(deleted, "failed").otherwise(F.col("status")).alias("status"),
        F.when(deleted, fv.REMOVED_MESSAGE).otherwise(F.col("error_msg")).alias("error_msg"),
        F.when(modified | deleted, at).otherwise(F.col("updated_at")).alias("updated_at"))
    new = changes.filter("change = 'added'").select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1)).alias("type"), "hash", "size",
        F.lit(dept_id).cast(documents.schema["dept_id"].dataType if "dept_id" in documents.columns else "long").alias("dept_id"),
        F.lit(role_id).cast(documents.schema["role_id"].dataType if "role_id" in documents.columns else "long").alias("role_id"),
        F.lit("pending").alias("status"), at.alias("updated_at"))
    new = new.select(*[c for c in new.columns if c in documents.columns])
    return updated.unionByName(new, allowMissingColumns=True)


def sync_metrics(changes: DataFrame, status: str = "success") -> DataFrame:
    count = lambda kind: F.count_if(F.col("change") == kind).alias(f"files_{kind}")
    return changes.agg(count("added"), count("modified"), count("deleted"),
                       F.count_if(F.col("change") == "moved").alias("files_moved"),
                       F.count_if(F.col("change") == "repeated").alias("files_repeated")).withColumn("status", F.lit(status))


def upsert_users(users: DataFrame, feed: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Users after a feed: rows matched by email take the feed's values, others are added.

    Of several feed rows with one email the last by `ord` counts. `change` says
    what happened; `added` rows have no user_id yet.
    """
    fields = ["usr_name", "dept_id", "role_id"]
    last = feed.groupBy("email").agg(*[F.max_by(c, "ord").alias(f"new_{c}") for c in fields]).withColumn("_fed", F.lit(True))
    both = users.join(last, "email", "full")
    change = F.when(F.col("user_id").isNull(), "added").when(F.col("_fed"), "updated").otherwise("kept")
    stamped = F.when(F.col("_fed") & F.col("user_id").isNotNull(), F.lit(as_of)).otherwise(F.col("updated_at"))
    return both.select("user_id", "email", *[F.coalesce(f"new_{c}", c).alias(c) for c in fields],
                       stamped.alias("updated_at"), change.alias("change"))


def documents_with_status(documents: DataFrame, *statuses: str) -> DataFrame:
    return documents.filter(F.col("status").isin(*statuses)).select("doc_id", "status")


def reset_failed(documents: DataFrame, as_of: datetime.datetime, ids: DataFrame | None = None) -> DataFrame:
    """Failed documents back to pending; no id table, or an empty one, means all. `was_reset` marks them."""
    chosen = F.coalesce(F.col("status") == "failed", F.lit(False))
    if ids is not None:
        named = ids.select("doc_id").distinct()
        documents = documents.join(named.withColumn("_chosen", F.lit(True)), "doc_id", "left")
        everyone = named.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() == 0
        chosen = chosen & (F.coalesce("_chosen", F.lit(False)) | everyone)
    return (documents.withColumn("was_reset", chosen)
            .withColumn("status", F.when(F.col("was_reset"), "pending").otherwise(F.col("status")))
            .withColumn("error_msg", F.when(~F.col("was_reset"), F.col("error_msg")))
            .withColumn("updated_at", F.when(F.col("was_reset"), F.lit(as_of)).otherwise(F.col("updated_at")))
            .drop("_chosen"))


def insert_absent(base: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """`base` with the new rows whose key it lacks; of equal new keys the first by `order`."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
    return base.unionByName(first.join(base, key, "left_anti").select(*base.columns))


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent was not deleted."""
    return child.join(deleted.select(key).distinct(), key, "left_anti")


def set_null(child: DataFrame, deleted: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows with the reference to a deleted parent cleared."""
    gone = deleted.select(F.col(parent_key or key).alias("_gone")).distinct()
    joined = child.join(gone, child[key] == gone["_gone"], "left")
    return joined.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


@dataclass(frozen=True)
class Reference:
    """`column` of `child` names a row of `parent` by its key; `action` says what a deleted parent does: `cascade` or `set null`."""

    child: str
    column: str
    parent: str
    action: str = "cascade"


def delete_along(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[Reference], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of all tables when the rows of `deleted` go, along the declared references, however many levels down.

    Level by level, the keys that go in one table take the rows that name them in others,
    until no new key is found, so tables may refer to themselves or in a circle. Only keys
    travel; each level of each table is one join, written to the shared folder. A table
    that others refer to has one key column. Null references name nothing.
    """
    gone = {name: rows.select(*keys[name]).distinct() for name, rows in deleted.items()}
    fresh = dict(gone)
    while fresh:
        found: dict[str, DataFrame] = {}
        for link in references:
            if link.action == "cascade" and link.parent in fresh:
                named = fresh[link.parent].select(F.col(keys[link.parent][0]).alias(link.column))
                rows = tables[link.child].join(named, link.column, "left_semi").select(*keys[link.child])
                found[link.child] = found[link.child].unionByName(rows) if link.child in found else rows
        fresh = {}
        for name, rows in found.items():
            rows = rows.distinct()
            rows = cut_lineage(rows.join(gone[name], keys[name], "left_anti") if name in gone else rows)
            if not rows.isEmpty():
                fresh[name] = rows
                gone[name] = gone[name].unionByName(rows) if name in gone else rows
    left = {name: rows.join(gone[name], keys[name], "left_anti") if name in gone else rows for name, rows in tables.items()}
    for link in references:
        if link.action == "set null" and link.parent in gone:
            columns = left[link.child].columns
            left[link.child] = set_null(left[link.child], gone[link.parent], link.column, keys[link.parent][0]).select(*columns)
    return left


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    have = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(have, key, "left_anti")


def domain_violations(df: DataFrame, key: list[str], domains: dict[str, list[str]] | None = None,
                      max_lengths: dict[str, int] | None = None, required: list[str] | None = None) -> DataFrame:
    """One row per broken rule: key, column_name, rule. Reads the table once."""
    checks = []
    for column, allowed in (domains or {}).items():
        checks.append((column, "domain", F.col(column).isNotNull() & ~F.col(column).isin(allowed)))
    for column, n in (max_lengths or {}).items():
        checks.append((column, "length", F.length(F.col(column)) > n))
    for column in required or []:
        checks.append((column, "required", F.col(column).isNull()))
    broken = F.array(*[F.when(test, F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"))) for c, rule, test in checks])
    return df.select(*key, F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("b")).select(*key, "b.*")


def replace_by_document(base: DataFrame, new: DataFrame, processed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """`base` with all rows of the processed documents replaced by `new`.

    A processed document without new rows is cleared.
    """
    return base.join(processed.select(doc).distinct(), doc, "left_anti").unionByName(new)
