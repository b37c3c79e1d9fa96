"""Prefix sums over a whole table, or within its groups, from per-partition totals.

Rows are range-partitioned by (group, order keys, random salt), so a partition
holds one stretch of the order; the salt splits even a stretch of equal keys.
The partition number is stored with the rows.  One small row of totals per
(group, partition) is summed before its partition, and a running sum inside
the partition adds the rest.  No task ever holds more than one partition, and a
group of any size spreads over many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stored

PART, SALT = "_part", "_salt"


def ranged(df: DataFrame, group: list[str], order: list[str], salt_seed: int = 17) -> DataFrame:
    """``df`` stored in range order, with its partition number and salt.  Group
    columns must not be NULL; order columns may be (NULLs last)."""
    n = shuffle_parts(df.sparkSession)
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    return stored(df.withColumn(SALT, F.xxhash64(F.monotonically_increasing_id(), F.lit(salt_seed)))
                  .repartitionByRange(n, *keys, F.col(SALT))
                  .withColumn(PART, F.spark_partition_id()))


def totals(t: DataFrame, group: list[str], sums: list[str]) -> DataFrame:
    """One row per (group, partition): its totals, and those of the group's
    partitions before it (``_o_<column>``, ``_o_rows``)."""
    per = t.groupBy(*group, PART).agg(
        F.count(F.lit(1)).alias("_t_rows"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        *group, PART, *[c for c in per.columns if c.startswith("_t_")],
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
          for c in ["rows", *sums]])


def running(t: DataFrame, offsets: DataFrame, group: list[str], order: list[str],
            sums: list[str]) -> DataFrame:
    """The rows of ``t`` with the offsets' columns and ``before_<column>``: the
    sum over all rows of the group that come earlier (``before_rows``: their
    number)."""
    keys: list[Column] = [F.col(c).asc_nulls_last() for c in [*order, SALT]]
    earlier = (Window.partitionBy(*group, PART).orderBy(*keys)
               .rowsBetween(Window.unboundedPreceding, -1))
    joined = t.join(offsets, [*group, PART])
    return joined.select(
        "*",
        (F.col("_o_rows") + F.coalesce(F.count(F.lit(1)).over(earlier), F.lit(0))).alias("before_rows"),
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(f"before_{c}")
          for c in sums])
