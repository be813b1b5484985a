"""Ordered work on groups of any size.

Each helper splits a group by a `bucket` column that grows with the order (a
day, a range of positions), works inside (group, bucket), and carries one
small row per bucket onward. So a key that holds a third of all rows is spread
over as many tasks as it has buckets.

Rows whose keys or bucket are null are kept: equal nulls make a group, and a null
bucket comes first. Nulls stand as a default beside a flag, so keys are plain columns that
joins and windows share one shuffle of, and the rows are read once.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIONS_PER_BUCKET = 4096


def position_bucket(position: Column, size: int = POSITIONS_PER_BUCKET) -> Column:
    return F.floor(position / size).cast("long")


#: Buckets per key that quantiles are counted in, at most.
RANGES = 256


_DEFAULTS = {T.StringType: "", T.BooleanType: False, T.DateType: datetime.date(1970, 1, 1), T.TimestampType: datetime.datetime(1970, 1, 1),
             **dict.fromkeys((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType), 0)}


def _with_cells(df: DataFrame, keys: list[str], bucket: str) -> tuple[DataFrame, list[str], list[str]]:
    """(df dealt by cell, the columns of a group, those of a cell): one cell is a bucket of a group, none of the columns is null."""
    columns, names = {}, []
    for i, k in enumerate([*keys, bucket]):
        kind = df.schema[k].dataType
        default = _DEFAULTS.get(type(kind))
        columns[f"_cell{i}"] = F.struct(k) if default is None else F.coalesce(F.col(k), F.lit(default).cast(kind))
        names.append(f"_cell{i}")
    nulls = [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)]
    columns["_nulls"] = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
    columns["_placed"] = F.col(bucket).isNotNull()
    group = [*names[:-1], "_nulls"]
    return df.withColumns(columns).repartition(*group, "_placed", names[-1]), group, [*group, "_placed", names[-1]]


def _cells_along(cell: list[str]) -> WindowSpec:
    """The buckets of one group in order."""
    return Window.partitionBy(*cell[:-2]).orderBy(*cell[-2:])


def number_within(df: DataFrame, keys: list[str], order: list, bucket: str, out: str) -> DataFrame:
    """Number the rows of each group from 0 in `order`."""
    df, _, cell = _with_cells(df, keys, bucket)
    sizes = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = _cells_along(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return (df.join(starts, cell)
            .withColumn(out, (F.col("_start") + inside - 1).cast("long"))
            .drop("_start", *cell))


def nearest_in_order(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column,
                     before: str | None = None, after: str | None = None) -> DataFrame:
    """The nearest non-null `value` at or before, and at or after, each row of its group.

    Per bucket only its first and last value cross to other buckets.
    """
    df, _, cell = _with_cells(df.withColumn("_v", value), keys, bucket)
    place = F.when(F.col("_v").isNotNull(), F.struct(*order))
    ends = df.groupBy(*cell).agg(F.min_by("_v", place).alias("_first"), F.max_by("_v", place).alias("_last"))
    along = _cells_along(cell)
    ends = ends.select(*cell, F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
                       F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    joined = df.join(ends, cell, "left")
    inside = Window.partitionBy(*cell).orderBy(*order)
    if before:
        back = F.last("_v", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        joined = joined.withColumn(before, F.coalesce(back, F.col("_earlier")))
    if after:
        ahead = F.first("_v", True).over(inside.rowsBetween(0, Window.unboundedFollowing))
        joined = joined.withColumn(after, F.coalesce(ahead, F.col("_later")))
    return joined.drop("_v", "_earlier", "_later", *cell)


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of `value` per group, and `n`, its number of rows.

    Equal values are counted first. Approximate quantiles of a group then cut its
    values into RANGES ranges of about equal numbers of rows; the counts are added up
    range by range. So a group is sorted by many tasks, and only its ranges, at most
    RANGES + 1 rows, are put in order together. The result does not depend on the cuts.
    """
    kept = df.filter(F.col(value).isNotNull()).select(*keys, value)
    names = F.struct(*keys)
    share = [i / RANGES for i in range(1, RANGES)]
    bounds = kept.groupBy(names.alias("_key")).agg(F.percentile_approx(value, share, 20 * RANGES).alias("_bounds"))
    counts = kept.groupBy(names.alias("_key"), value).agg(F.count(F.lit(1)).alias("_c")).join(bounds, "_key")
    counts = counts.withColumn("_b", F.size(F.filter("_bounds", lambda b: b <= F.col(value)))).drop("_bounds")
    sizes = counts.groupBy(F.struct("_key", "_b").alias("_cell")).agg(F.sum("_c").alias("_size"))
    of_key = Window.partitionBy("_cell._key")
    before = of_key.orderBy("_cell._b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_cell", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(of_key).alias("n"))
    upto = Window.partitionBy("_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_cell", F.struct("_key", "_b")).join(starts, "_cell").withColumn("_end", F.col("_start") + F.sum("_c").over(upto))

    def at(index):  # the value at a 0-based place
        return F.max(F.when((index >= F.col("_end") - F.col("_c")) & (index < F.col("_end")), F.col(value)))

    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in wanted.items()}
    picked = placed.select("_key.*", "n", "_start", "_end", "_c", value).groupBy(*keys, "n").agg(*[
        at(edge(place[name])).alias(f"_{side}_{name}") for name in wanted for side, edge in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda name: F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place[name] - F.floor(place[name]))
    return picked.select(*keys, "n", *[between(name).alias(name) for name in wanted])


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; tasks keep k rows per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= k)
