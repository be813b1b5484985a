"""Who may see which document."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_grants(grants: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Distinct (user_id, folder_id) that are active and not expired at `as_of`."""
    at = F.lit(as_of)
    live = grants.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > at)))
    return live.select("user_id", "folder_id").distinct()


def with_folders(queries: DataFrame, grants: DataFrame) -> DataFrame:
    """Add each query's folder_ids; the set is at most the number of folders."""
    asked = queries.select("user_id").distinct()
    sets = grants.join(asked, "user_id", "left_semi").groupBy("user_id").agg(
        F.collect_set("folder_id").alias("folder_ids"))
    return queries.join(sets, "user_id", "left")


def may_see(scope: Column, dept: Column, folders: Column, doc_dept: Column, doc_folder: Column) -> Column:
    """`dept`: same department; `folder`: a granted folder; any other scope: either.

    Used as a filter on pairs an equi-join on terms has already found, so it
    never becomes the condition of a join.
    """
    same_dept = F.coalesce(dept == doc_dept, F.lit(False))
    granted = F.coalesce(F.array_contains(folders, doc_folder), F.lit(False))
    return F.when(scope == "dept", same_dept).when(scope == "folder", granted).otherwise(same_dept | granted)


def visible_counts(users: DataFrame, grants: DataFrame, documents: DataFrame) -> DataFrame:
    """Indexed documents each user may see, by scope.

    Documents are first counted into (department, folder) cells; users meet
    cells through two equi-joins and never meet documents.
    """
    cells = (documents.filter("status = 'indexed'").groupBy("dept_id", "folder_id")
             .agg(F.count(F.lit(1)).alias("n")))
    own = users.join(cells, "dept_id").select("user_id", "folder_id", "n")
    by_dept = own.groupBy("user_id").agg(F.sum("n").alias("dept"))
    held = users.select("user_id", F.col("dept_id").alias("own_dept")).join(grants, "user_id")
    folder_cells = held.join(cells, "folder_id")
    by_folder = folder_cells.groupBy("user_id").agg(
        F.sum("n").alias("folder"),
        F.sum(F.when(~F.col("dept_id").eqNullSafe(F.col("own_dept")), F.col("n")).otherwise(0)).alias("beyond"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (users.select("user_id").join(by_dept, "user_id", "left").join(by_folder, "user_id", "left")
            .select("user_id", zero("dept").alias("dept_docs"), zero("folder").alias("folder_docs"),
                    (zero("dept") + zero("beyond")).alias("all_docs")))
