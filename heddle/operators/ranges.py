"""Running sums and row numbers in two levels: rows are dealt into sorted ranges, and sums of whole ranges come before.

A window over all rows of a group runs in one task, however large the group is.  Here a sort deals the rows into ranges,
which cut large groups (the sampling of the range partitioner sees to that); a window runs within each range alone, and a
second one over the ranges of a group, one row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.staging import stage


def running(rows: DataFrame, groups: list[str], order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with, for each of sums, the sum over the rows before in the group (name) and over all of it (name_total).

    order must tell all rows of a group apart, but for rows that may change places.  A null group is a group.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = rows.withColumns({f"_{k}": v for k, v in sums.items()})
    # The id's high bits number the range, its low ones the row within it: the order is kept when the rows are read again.
    keys = [F.col(g) for g in groups] or [F.lit(0)]
    dealt = given.repartitionByRange(parts, *([F.col(g) for g in groups]), *order).sortWithinPartitions(*[F.col(g) for g in groups], *order)
    dealt = stage(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "ranges")
    within = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy(*groups, "_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), *[F.sum(f"_{k}").over(before).alias(f"_{k}_before") for k in sums], *[F.sum(f"_{k}").over(Window.partitionBy(*keys)).alias(f"{k}_total") for k in sums]
    )
    zero = F.lit(0)
    out = dealt.select("*", *[F.sum(f"_{k}").over(within).alias(f"_{k}_within") for k in sums])
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_range") == F.col("_r"))
    out = out.join(whole, same)
    kept = [c for c in rows.columns if c not in sums]
    return out.select(*kept, *[(F.coalesce(f"_{k}_within", zero) + F.coalesce(f"_{k}_before", zero)).alias(k) for k in sums], *[f"{k}_total" for k in sums])


def numbered(rows: DataFrame, order: list[Column], name: str = "number", parts: int | None = None) -> DataFrame:
    """rows with their number from 1 in the given order; rows that are alike in it follow each other by the hash of the row."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    out = running(rows.withColumn("_tie", tie), [], [*order, F.col("_tie")], {name: F.lit(1)}, parts)
    return out.withColumn(name, (F.col(name) + 1).cast("bigint")).drop("_tie", f"{name}_total")
