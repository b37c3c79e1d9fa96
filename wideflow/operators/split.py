"""SPL-1..3: exact stratified splits and folds.

numpy's seeded shuffles cannot be replayed in Spark, so the seeded order is
*defined* as ``md5('<seed>:<id>')`` with the id as tie-break.  Class sizes
follow the reference library's allocation exactly:

* split: ``n_test = ceil(test_size * n)``, ``n_train = n - n_test``; train
  rows per class by largest remainder of ``c / n * n_train`` (ties between
  equal remainders go to the smaller label); the rest of the class is test.
* k-fold: with classes sorted, the j-th row (1-based, seeded order) of a
  class whose predecessors hold ``o`` rows goes to fold ``(o + j - 1) % k``:
  fold i receives rows i, i+k, ... of the label-sorted list, as in the
  reference library.

Ranks within a class are computed in two levels (md5 prefix buckets), so a
class holding half of a 100 TB table is not one window task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideflow.functions.expr import hex_bucket, md5_order_key
from wideflow.functions.ranking import digits_for, ranked_within
from wideflow.session import materialize

KEY = "__key"


def seeded_rank(df: DataFrame, id_col: str, label: str, seed: int | Column, rows: int,
                partition_cols: Sequence[str] = (), out: str = "class_rank") -> DataFrame:
    """1-based rank of each row inside its class in the seeded md5 order;
    ``rows`` is the size of the largest class."""
    d = df.withColumn(KEY, md5_order_key(seed, id_col))
    r = ranked_within(d, [*partition_cols, label], [F.col(KEY), F.col(id_col)],
                      hex_bucket(KEY, digits_for(rows)), out)
    return r.drop(KEY)


def train_allocation(df: DataFrame, label: str, ratios: Sequence[float]) -> DataFrame:
    """(ratio_idx, split_ratio, label, n_class, n_train) for every test share.

    Works on the per-class count table only (classes x ratios rows).
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("ratio_idx"), F.lit(float(r)).alias("split_ratio"))
                               for i, r in enumerate(ratios)])).alias("g")
    a = counts.select(label, "n_class", grid).select(label, "n_class", "g.*")
    per_ratio = Window.partitionBy("ratio_idx")
    n = F.sum("n_class").over(per_ratio)
    a = a.withColumn("__n", n)
    a = a.withColumn("__ntrain", F.col("__n") - F.ceil(F.col("split_ratio") * F.col("__n")))
    cont = F.col("n_class").cast("double") / F.col("__n") * F.col("__ntrain")
    a = a.withColumn("__floor", F.floor(cont)).withColumn("__rem", cont - F.floor(cont))
    need = F.col("__ntrain") - F.sum("__floor").over(per_ratio)
    pos = F.row_number().over(per_ratio.orderBy(F.col("__rem").desc(), F.col(label).asc()))
    a = a.withColumn("n_train", (F.col("__floor") + F.when(pos <= need, 1).otherwise(0)).cast("bigint"))
    return a.select("ratio_idx", "split_ratio", label, "n_class", "n_train")


def _bucket_status(counts: DataFrame, parts: Sequence[str], cuts: DataFrame, join_col: str,
                   cut_cols: Sequence[str]) -> DataFrame:
    """Per (parts, ``__b``) bucket with ``__n`` rows: the rank before it
    (``__o``), for every cut whether the bucket lies beyond it
    (``__all_out_<c>``), and whether any cut falls inside (``__straddle``)."""
    w = Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    status = counts.withColumn("__o", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    status = status.join(cuts, on=join_col, how="inner")
    straddle = F.lit(False)
    sel = [*parts, "__b", "__o"]
    for c in cut_cols:
        lo, hi = F.col("__o"), F.col("__o") + F.col("__n")
        straddle = straddle | ((lo < F.col(c)) & (hi > F.col(c)))
        sel += [c, (lo >= F.col(c)).alias(f"__all_out_{c}")]
    return materialize(status.select(*sel, straddle.alias("__straddle")))


def _beyond_cuts(d: DataFrame, parts: Sequence[str], id_col: str, cuts: DataFrame,
                 cut_cols: Sequence[str], join_col: str, rows: int) -> DataFrame:
    """Add boolean ``__out_<c>`` = (seeded rank within ``parts`` > cut ``c``).

    The rank order is (md5 key, id).  Rows are bucketed by the key's leading
    hex digits (as many as the largest class of ``rows`` rows asks for);
    per-bucket counts give each bucket's rank range, so a bucket lies wholly
    below or wholly above a cut, except the one bucket per cut that straddles
    it.  Only rows of straddling buckets are ranked exactly.
    """
    p = list(parts)
    d = d.withColumn("__b", hex_bucket(KEY, digits_for(rows)))
    counts = d.groupBy(*p, "__b").agg(F.count(F.lit(1)).alias("__n"))
    status = _bucket_status(counts, p, cuts, join_col, cut_cols)
    j = d.join(status, on=[*p, "__b"], how="inner")
    exact = j.where(F.col("__straddle"))
    rank = F.row_number().over(Window.partitionBy(*p, "__b").orderBy(F.col(KEY), F.col(id_col))) + F.col("__o")
    exact = exact.select("*", *[(rank > F.col(c)).alias(f"__out_{c}") for c in cut_cols])
    rest = j.where(~F.col("__straddle"))
    rest = rest.select("*", *[F.col(f"__all_out_{c}").alias(f"__out_{c}") for c in cut_cols])
    drop = ["__b", "__o", "__straddle", *cut_cols, *[f"__all_out_{c}" for c in cut_cols]]
    return exact.unionByName(rest).drop(*drop)


def stratified_split(df: DataFrame, id_col: str, label: str, test_size: float = 0.2,
                     seed: int = 11, out: str = "split") -> DataFrame:
    """SPL-1: add ``split`` = 'train' / 'test'.  Rows with a NULL label are dropped."""
    d = df.where(F.col(label).isNotNull())
    alloc = materialize(train_allocation(d, label, [test_size]).select(label, "n_class", "n_train"))
    d = d.withColumn(KEY, md5_order_key(seed, id_col))
    r = _beyond_cuts(d, [label], id_col, alloc.drop("n_class"), ["n_train"], label, _largest(alloc))
    return (r.withColumn(out, F.when(F.col("__out_n_train"), "test").otherwise("train"))
             .drop(KEY, "__out_n_train"))


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 11,
                     out: str = "fold") -> DataFrame:
    """SPL-2: add ``fold`` in 0..k-1.  Rows with a NULL label are dropped."""
    d = df.where(F.col(label).isNotNull())
    counts = materialize(d.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")))
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, F.coalesce(F.sum("n_class").over(before), F.lit(0)).alias("__off"))
    # ``offsets`` has one row per class.
    r = seeded_rank(d, id_col, label, seed, _largest(counts), out="__rank")
    r = r.join(offsets, on=label, how="inner")
    return (r.withColumn(out, ((F.col("__off") + F.col("__rank") - 1) % k).cast("int"))
             .drop("__rank", "__off"))


def stratified_split_kfold(df: DataFrame, id_col: str, label: str, test_size: float = 0.2, k: int = 5,
                           seed: int = 11, split: str = "split", fold: str = "fold") -> DataFrame:
    """SPL-1, and SPL-2 inside each split with the same seed, by one ranking: the
    train rows of a class are the first in its seeded order, so a row's rank inside
    its split is its rank in the class, less the train rows for a test row."""
    d = df.where(F.col(label).isNotNull())
    alloc = materialize(train_allocation(d, label, [test_size]).select(label, "n_class", "n_train"))
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    # ``cuts`` has one row per class.
    cuts = alloc.select(label, F.col("n_train").alias("__cut"),
                        F.coalesce(F.sum("n_train").over(before), F.lit(0)).alias("__off_train"),
                        F.coalesce(F.sum(F.col("n_class") - F.col("n_train")).over(before), F.lit(0)).alias("__off_test"))
    r = seeded_rank(d, id_col, label, seed, _largest(alloc), out="__rank").join(cuts, on=label, how="inner")
    test = F.col("__rank") > F.col("__cut")
    place = F.when(test, F.col("__off_test") + F.col("__rank") - F.col("__cut")).otherwise(
        F.col("__off_train") + F.col("__rank"))
    return (r.withColumn(split, F.when(test, "test").otherwise("train"))
             .withColumn(fold, ((place - 1) % k).cast("int"))
             .drop("__rank", "__cut", "__off_train", "__off_test"))


def _largest(classes: DataFrame) -> int:
    """Rows of the largest class of a stored class table."""
    return classes.agg(F.max("n_class")).first()[0] or 0


def sweep_test_counts(df: DataFrame, id_col: str, label: str, score: str,
                      seeds: Sequence[int], ratios: Sequence[float]) -> DataFrame:
    """SPL-3: (seed, split_ratio, score, pos, neg) over the test part of every split.

    Each seed's order is ranked once; all ratios are then counted in one
    conditional aggregation, so there is no rows x ratios expansion and the
    whole grid is one job.
    """
    d = (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
           .select(id_col, label, F.col(score).cast("double").alias("score")))
    # The rows are about to be fanned out over the seeds: enough partitions for that.
    d = materialize(d, spread=True)
    score = "score"
    alloc = materialize(train_allocation(d, label, ratios))
    nr = len(ratios)
    cut_cols = [f"__nt{i}" for i in range(nr)]
    wide = (alloc.groupBy(label).pivot("ratio_idx", list(range(nr))).agg(F.first("n_train"))
            .select(label, *[F.col(str(i)).alias(c) for i, c in enumerate(cut_cols)]))
    wide = materialize(wide)
    seeded = d.select("*", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    seeded = seeded.withColumn(KEY, md5_order_key(F.col("seed"), id_col)).withColumn(
        "__b", hex_bucket(KEY, digits_for(_largest(alloc))))
    parts = ["seed", label]
    # One pass over all seeded rows; everything but the straddling buckets is
    # settled on its counts.
    table = materialize(seeded.groupBy(*parts, "__b", score).agg(F.count(F.lit(1)).alias("__n")))
    counts = table.groupBy(*parts, "__b").agg(F.sum("__n").alias("__n"))
    status = _bucket_status(counts, parts, wide, label, cut_cols)
    whole = table.join(status.where(~F.col("__straddle")), on=[*parts, "__b"]).groupBy(*parts, score).agg(
        *[F.sum(F.when(F.col(f"__all_out_{c}"), F.col("__n")).otherwise(0)).alias(f"__t{i}")
          for i, c in enumerate(cut_cols)])
    # seeds x classes x ratios rows at most: a proven bound
    cut = F.broadcast(status.where("__straddle"))
    rank = F.row_number().over(Window.partitionBy(*parts, "__b").orderBy(F.col(KEY), F.col(id_col)))
    exact = seeded.join(cut, on=[*parts, "__b"]).withColumn("__rank", rank + F.col("__o")).groupBy(*parts, score).agg(
        *[F.sum((F.col("__rank") > F.col(c)).cast("int")).alias(f"__t{i}") for i, c in enumerate(cut_cols)])
    agg = whole.unionByName(exact)
    per = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("split_ratio"), F.col(f"__t{i}").alias("n"))
                              for i, x in enumerate(ratios)])).alias("p")
    long = agg.select("seed", label, score, per).select("seed", label, score, "p.*")
    return materialize(long.groupBy("seed", "split_ratio", score)
                .agg(F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).cast("bigint").alias("pos"),
                     F.sum(F.when(F.col(label) == 1, 0).otherwise(F.col("n"))).cast("bigint").alias("neg"))
                .where((F.col("pos") + F.col("neg")) > 0))
