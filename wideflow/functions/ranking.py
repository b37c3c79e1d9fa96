"""Two-level ranks and running sums.

A window with no PARTITION BY (or partitioned only by a two-valued label)
runs in one task.  Every ordered computation in this library goes through
the helpers below instead:

1. tag each row with a *bucket* that is monotone in the order: a leading
   part of an md5 key, or the number of the row's partition after a range
   partitioning by (group, order), stored with the rows;
2. aggregate per (group, bucket): a small table;
3. prefix-sum that table over the bucket order to get offsets;
4. join the offsets back and finish with a window partitioned by
   (group, bucket), i.e. many small independent tasks.

Range partitions follow the data (Spark samples the order column), so values
that lie close together at a large offset spread as well as any others.  The
result is exact for any bucket that is non-decreasing in the order.
"""

from __future__ import annotations

from math import ceil, log
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideflow.session import materialize

_B = "__bucket"


def range_buckets(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` range-partitioned by ``order`` and stored, with the partition's
    number as its bucket."""
    return materialize(df.repartitionByRange(*order).withColumn(_B, F.spark_partition_id()))


def digits_for(rows: int, per_bucket: int = 50_000) -> int:
    """Hex digits of an md5 key after which a bucket holds about
    ``per_bucket`` of ``rows`` rows or fewer (3 at least)."""
    return max(3, ceil(log(max(rows / per_bucket, 1), 16)))


def ranked_within(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[Column],
                  bucket: Column | None = None, out: str = "rank") -> DataFrame:
    """Exact ``row_number() OVER (PARTITION BY partition_cols ORDER BY order_cols)``.

    ``bucket`` must be non-decreasing in ``order_cols`` (ascending order);
    without one the rows are range-partitioned.  Partition columns must be
    non-NULL.
    """
    p = list(partition_cols)
    d = range_buckets(df, [*p, *order_cols]) if bucket is None else df.withColumn(_B, bucket)
    counts = d.groupBy(*p, _B).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*p).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*p, _B, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    d = d.join(offsets, on=[*p, _B], how="inner")
    wl = Window.partitionBy(*p, _B).orderBy(*order_cols)
    return d.withColumn(out, F.row_number().over(wl) + F.col("__off")).drop(_B, "__off")


def ordered_scan(df: DataFrame, group_cols: Sequence[str], order_col: str,
                 sum_cols: Sequence[str], descending: bool = True) -> DataFrame:
    """Running sums over rows that are unique per (group, order_col).

    Adds, for every ``c`` in ``sum_cols``: ``cum_c`` (inclusive prefix in scan
    order), ``prev_c`` (the previous row's ``cum_c``, 0 for the first row) and
    ``next_c`` (the next row's ``cum_c``, NULL for the last row).
    """
    g = list(group_cols)
    o = F.col(order_col)
    d = range_buckets(df, [*g, order_col])
    first_of = F.max_by if descending else F.min_by
    tot = d.groupBy(*g, _B).agg(
        *[F.sum(c).alias(f"__t_{c}") for c in sum_cols],
        *[first_of(F.col(c), o).alias(f"__f_{c}") for c in sum_cols],
    )
    border = F.col(_B).desc() if descending else F.col(_B).asc()
    wb = Window.partitionBy(*g).orderBy(border)
    wbp = wb.rowsBetween(Window.unboundedPreceding, -1)
    sel = [*g, _B]
    for c in sum_cols:
        off = F.coalesce(F.sum(f"__t_{c}").over(wbp), F.lit(0))
        sel.append(off.alias(f"__o_{c}"))
        sel.append((F.lead(f"__f_{c}").over(wb) + off + F.col(f"__t_{c}")).alias(f"__nf_{c}"))
    tot = tot.select(*sel)
    d = d.join(tot, on=[*g, _B], how="inner")
    rorder = o.desc() if descending else o.asc()
    wr = Window.partitionBy(*g, _B).orderBy(rorder)
    wrc = wr.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in sum_cols:
        cum = F.sum(c).over(wrc) + F.col(f"__o_{c}")
        d = d.withColumn(f"cum_{c}", cum)
        d = d.withColumn(f"prev_{c}", F.col(f"cum_{c}") - F.col(c))
        d = d.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(wr) + F.col(f"cum_{c}"), F.col(f"__nf_{c}")))
    drop = [_B] + [f"__{k}_{c}" for c in sum_cols for k in ("o", "nf")]
    return d.drop(*drop)
