"""Sharding into contiguous ranges of near-equal bytes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .prefix import ranged, running, totals


def assign_shards(rows: DataFrame, n_shards: int, size: str, order: list[str]) -> DataFrame:
    """The columns of ``rows`` plus ``shard`` (0 .. n_shards - 1) and ``slot``
    (0, 1, ... within the shard, in order).

    Rows are put in the order of ``order`` (NULLs last; equal rows in any
    order).  With prefix sums of ``size`` (a non-negative long) over the whole
    table, the total is cut at n_shards - 1 equal targets, and a row goes to
    the shard in which its middle byte lies, so every cut is off its target by
    half a row at most.  A row larger than a shard's target may leave a
    neighbouring shard without rows.  If all sizes are zero every row goes to
    shard 0; an empty table gives an empty result.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    t = ranged(rows.select(*columns), [], order)
    offsets = totals(t, [], [size])
    # offsets has one row per partition, so this window is small
    offsets = offsets.withColumn("_total", F.sum(f"_t_{size}").over(Window.partitionBy()))
    placed = stored(
        running(t, offsets, [], order, [size])
        .withColumn("shard", F.when(F.col("_total") > 0, F.least(
            F.lit(n_shards - 1),
            F.expr(f"(2 * before_{size} + {size}) * {n_shards} div (2 * _total)")))
            .otherwise(F.lit(0)).cast("int"))
        .select(*columns, "shard", "before_rows"))
    # n_shards rows: a proven bound
    first = placed.groupBy("shard").agg(F.min("before_rows").alias("_first"))
    return (placed.join(F.broadcast(first), "shard")
            .select(*columns, "shard", (F.col("before_rows") - F.col("_first")).alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
