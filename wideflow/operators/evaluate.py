"""EVL-1..11, THR-1..3, SWP-1..2: binary-classifier evaluation.

Everything starts from a *score-count table* ``(by..., score, pos, neg)``:
one row per distinct score per group.  Curves and areas are running sums
over that table in descending score order (``ordered_scan``), so the row
data is shuffled once and never sorted as a whole.

Rows whose label or score is NULL are ignored.  Where the reference would
divide by zero (no positives, no predicted positives, a single-class fold)
the result is NULL.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideflow.functions.expr import ratio, THRESHOLD_INDEX_MAX
from wideflow.functions.ranking import ordered_scan
from wideflow.session import materialize


def _by(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


_ALL = "__all"


def _keyed(df: DataFrame, g: list[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped table a constant group key so joins stay equi-joins."""
    if g:
        return df, g
    return df.withColumn(_ALL, F.lit(0)), [_ALL]


def _unkey(df: DataFrame) -> DataFrame:
    return df.drop(_ALL)


def score_counts(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(by..., score, pos, neg): positives and negatives per distinct score."""
    g = _by(by)
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return materialize(d.groupBy(*g, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).cast("bigint").alias("pos"),
        F.count_if(F.col(label) != 1).cast("bigint").alias("neg")))


# ---------------------------------------------------------------- EVL-1..3, 9
def confusion_from_counts(counts: DataFrame, thresh: float | Column, by=()) -> DataFrame:
    g = _by(by)
    t = thresh if isinstance(thresh, Column) else F.lit(float(thresh))
    above = F.col("score") > t
    return counts.groupBy(*g).agg(
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).cast("bigint").alias("tp"))


def confusion(df: DataFrame, label: str, score: str, thresh: float = 0.5, by=()) -> DataFrame:
    """EVL-1: tn, fp, fn, tp of ``score > thresh`` (strict) against ``label``."""
    g = _by(by)
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    pred = F.col(score) > F.lit(float(thresh))
    y = F.col(label) == 1
    return d.groupBy(*g).agg(
        F.count_if(~y & ~pred).cast("bigint").alias("tn"),
        F.count_if(~y & pred).cast("bigint").alias("fp"),
        F.count_if(y & ~pred).cast("bigint").alias("fn"),
        F.count_if(y & pred).cast("bigint").alias("tp"))


def rate_columns(as_coded: bool = False) -> list[Column]:
    """EVL-2/3 on columns tn, fp, fn, tp.  ``as_coded`` repeats the sweep
    script's accuracy formula (tp+tn)/(tp+fp+tn+fp)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    den = (tp + fp + tn + fp) if as_coded else (tp + tn + fp + fn)
    precision = ratio(tp, tp + fp)
    recall = ratio(tp, tp + fn)
    return [
        ratio(tp + tn, den).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(F.lit(2.0) * precision * recall, precision + recall).alias("f1_score"),
    ]


def rates(cm: DataFrame, as_coded: bool = False) -> DataFrame:
    return cm.select("*", *rate_columns(as_coded))


def decision_point(cm: DataFrame) -> DataFrame:
    """EVL-9: the threshold's point on the ROC and PR planes."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.select("*", ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fn).alias("tpr"),
                     ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"))


# ---------------------------------------------------------------- EVL-4..7
def _scan(counts: DataFrame, by) -> DataFrame:
    return ordered_scan(counts, _by(by), "score", ["pos", "neg"], descending=True)


def areas_from_counts(counts: DataFrame, by=()) -> DataFrame:
    """EVL-5 and EVL-7: (by..., auc, pr_auc), both trapezoidal.

    ROC: sum over distinct scores of neg_i * (cum_pos_i + prev_pos_i) / 2,
    over P * N (ties count one half).  PR: the curve is anchored at
    (recall 0, precision 1) as in the reference library, which Spark's
    ``areaUnderPR`` is not.
    """
    g = _by(by)
    s = _scan(counts, g)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    prev_den = F.col("prev_pos") + F.col("prev_neg")
    prev_prec = F.when(prev_den == 0, F.lit(1.0)).otherwise(F.col("prev_pos") / prev_den)
    s = s.select(*g, "pos", "neg",
                 (F.col("neg") * (F.col("cum_pos") + F.col("prev_pos"))).alias("__roc2"),
                 (F.col("pos") * (prec + prev_prec)).alias("__pr2"))
    agg = s.groupBy(*g).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"),
                            F.sum("__roc2").alias("__roc2"), F.sum("__pr2").alias("__pr2"))
    return agg.select(*g,
                      ratio(F.col("__roc2"), F.lit(2) * F.col("__p") * F.col("__n")).alias("auc"),
                      ratio(F.col("__pr2"), F.lit(2) * F.col("__p")).alias("pr_auc"))


def roc_auc(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    return areas_from_counts(score_counts(df, label, score, by), by).drop("pr_auc")


def pr_auc(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    return areas_from_counts(score_counts(df, label, score, by), by).drop("auc")


def roc_points(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """EVL-4: (by..., threshold, fpr, tpr), one point per distinct score.

    Collinear interior points are dropped as the reference library does by
    default; the (0, 0) anchor has a NULL threshold.
    """
    counts, g = _keyed(score_counts(df, label, score, _by(by)), _by(by))
    s = _scan(counts, g)
    tot = s.groupBy(*g).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    d2 = lambda c: F.col(f"next_{c}") - F.lit(2) * F.col(f"cum_{c}") + F.col(f"prev_{c}")
    first = (F.col("prev_pos") + F.col("prev_neg")) == 0
    keep = first | F.col("next_pos").isNull() | (d2("pos") != 0) | (d2("neg") != 0)
    # ``tot`` has one row per curve; Spark broadcasts it while it is small.
    pts = s.where(keep).join(tot, on=g, how="inner")
    pts = pts.select(*g, F.col("score").alias("threshold"),
                     ratio("cum_neg", "__n").alias("fpr"), ratio("cum_pos", "__p").alias("tpr"))
    anchor = tot.select(*g, F.lit(None).cast("double").alias("threshold"),
                        F.when(F.col("__n") > 0, F.lit(0.0)).alias("fpr"),
                        F.when(F.col("__p") > 0, F.lit(0.0)).alias("tpr"))
    return _unkey(pts.unionByName(anchor))


def pr_points(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """EVL-6: (by..., threshold, precision, recall) plus the (1, 0) anchor."""
    counts, g = _keyed(score_counts(df, label, score, _by(by)), _by(by))
    s = _scan(counts, g)
    tot = s.groupBy(*g).agg(F.sum("pos").alias("__p"))
    pts = s.join(tot, on=g, how="inner")
    pts = pts.select(*g, F.col("score").alias("threshold"),
                     ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                     ratio("cum_pos", "__p").alias("recall"))
    anchor = tot.select(*g, F.lit(None).cast("double").alias("threshold"),
                        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return _unkey(pts.unionByName(anchor))


def prevalence(df: DataFrame, label: str, by=()) -> DataFrame:
    """AGG-8: share of positives (the no-skill precision)."""
    g = _by(by)
    d = df.where(F.col(label).isNotNull())
    return d.groupBy(*g).agg(F.avg(F.col(label).cast("double")).alias("prevalence"))


# ---------------------------------------------------------------- EVL-8
def score_histogram(df: DataFrame, label: str, score: str, bins: int = 25) -> DataFrame:
    """EVL-8: per class, ``bins`` equal-width bins over that class's own
    [min, max] (last bin closed; a one-value class uses value +- 0.5),
    density = count / (n * width)."""
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.col(label).alias("label"), F.col(score).cast("double").alias("x"))
    st = d.groupBy("label").agg(F.min("x").alias("__mn"), F.max("x").alias("__mx"),
                                F.count(F.lit(1)).alias("__n"))
    lo = F.when(F.col("__mn") == F.col("__mx"), F.col("__mn") - 0.5).otherwise(F.col("__mn"))
    hi = F.when(F.col("__mn") == F.col("__mx"), F.col("__mx") + 0.5).otherwise(F.col("__mx"))
    st = st.select("label", lo.alias("lo"), hi.alias("hi"), "__n")
    j = d.join(st, on="label", how="inner")  # st has one row per class
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.floor((F.col("x") - F.col("lo")) / width).cast("int")
    b = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    j = j.withColumn("bin", b)
    counts = j.groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = st.select("label", "lo", "hi", "__n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, on=["label", "bin"], how="left")
    w = (F.col("hi") - F.col("lo")) / bins
    return out.select("label", "bin",
                      (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
                      (F.coalesce(F.col("n"), F.lit(0)) / (F.col("__n") * w)).alias("density"))


# ---------------------------------------------------------------- EVL-10, 11
def performance_from_counts(counts: DataFrame, thresh: float | Column, by=(),
                            as_coded: bool = False) -> DataFrame:
    counts, g = _keyed(counts, _by(by))
    cm = confusion_from_counts(counts, thresh, g)
    areas = areas_from_counts(counts, g)
    joined = cm.join(areas, on=g, how="inner")
    t = thresh if isinstance(thresh, Column) else F.lit(float(thresh))
    return _unkey(joined.select(*g, t.cast("double").alias("decision_threshold"),
                                "tn", "fp", "fn", "tp", *rate_columns(as_coded), "auc", "pr_auc"))


def binary_performance(df: DataFrame, label: str, score: str, thresh: float = 0.5, by=(),
                       as_coded: bool = False) -> DataFrame:
    """EVL-10: the metric record (threshold, tn, fp, fn, tp, accuracy,
    precision, recall, f1, auc, pr_auc), optionally per group."""
    return performance_from_counts(score_counts(df, label, score, by), thresh, by, as_coded)


def compare_models(df: DataFrame, label: str, scores: dict[str, tuple[str, float]]) -> DataFrame:
    """EVL-11: metric records of several (score column, threshold) pairs,
    one row per model name, in one pass over the rows."""
    parts = [F.struct(F.lit(name).alias("model"), F.col(col).cast("double").alias("__s"),
                      F.lit(float(t)).alias("__t"))
             for name, (col, t) in scores.items()]
    long = df.select(label, F.explode(F.array(*parts)).alias("m")).select(label, "m.*")
    counts = score_counts(long.withColumnRenamed("__s", "s"), label, "s", ["model", "__t"])
    rec = performance_from_counts(counts, F.col("__t"), ["model", "__t"])
    return rec.drop("__t")


# ---------------------------------------------------------------- THR-1..3
def threshold_value(idx: Column) -> Column:
    """Grid value of index i: 0.01 + i * 0.001 (as a double, in both engines)."""
    return F.lit(0.01) + idx.cast("double") * F.lit(0.001)


def thresholds_below(score: Column) -> Column:
    """Number of grid thresholds strictly below ``score`` (0..980)."""
    n = THRESHOLD_INDEX_MAX + 1
    c = F.least(F.greatest(F.ceil((score - F.lit(0.01)) / F.lit(0.001)), F.lit(0)), F.lit(n)).cast("int")
    up = (c < n) & (threshold_value(c) < score)
    down = (c > 0) & (threshold_value(c - 1) >= score)
    return (c + F.when(up, 1).otherwise(0) - F.when(down, 1).otherwise(0)).cast("int")


def threshold_sweep(df: DataFrame, label: str, score: str, fold: str = "fold", by=()) -> DataFrame:
    """THR-1: (by..., fold, threshold_idx, threshold, roc_auc) for 980 thresholds.

    ROC AUC of the binarised prediction ``score > t`` equals (TPR + TNR) / 2.
    Each row is counted once under the number of thresholds below its score;
    a reversed running sum over at most 981 buckets per fold gives all 980
    confusion matrices, so the rows are never multiplied by the grid.
    """
    g = [*_by(by), "fold"]
    n = THRESHOLD_INDEX_MAX + 1
    d = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    k = thresholds_below(F.col(score).cast("double"))
    counts = materialize(d.groupBy(*_by(by), F.col(fold).alias("fold"), k.alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))
    folds = counts.groupBy(*g).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    grid = folds.select(*g, "__p", "__n", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    dense = grid.join(counts, on=[*g, "k"], how="left").fillna(0, subset=["pos", "neg"])
    w = Window.partitionBy(*g).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.select(*g, "k", "__p", "__n",
                         F.coalesce(F.sum("pos").over(w), F.lit(0)).alias("tp"),
                         F.coalesce(F.sum("neg").over(w), F.lit(0)).alias("fp"))
    dense = dense.where(F.col("k") < n)
    tpr = ratio("tp", "__p")
    tnr = ratio(F.col("__n") - F.col("fp"), "__n")
    return dense.select(*g, F.col("k").alias("threshold_idx"),
                        threshold_value(F.col("k")).alias("threshold"),
                        ((tpr + tnr) / 2).alias("roc_auc"))


def threshold_avg(sweep: DataFrame, by=()) -> DataFrame:
    """THR-2: mean over folds, skipping NULL folds."""
    return sweep.groupBy(*_by(by), "threshold_idx", "threshold").agg(F.avg("roc_auc").alias("avg_roc_auc"))


def best_threshold(avg: DataFrame, by=()) -> DataFrame:
    """THR-3: first maximum (lowest index among ties; NULL averages ignored),
    for every group of ``by``.  Averages that agree to 12 digits are ties: the
    order in which folds are summed must not decide."""
    order = [F.round("avg_roc_auc", 12).desc(), F.col("threshold_idx").asc()]
    known = avg.where(F.col("avg_roc_auc").isNotNull())
    if not _by(by):
        return known.orderBy(*order).limit(1)
    first = Window.partitionBy(*_by(by)).orderBy(*order)       # a grid's size
    return known.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n")


def threshold_pivot(sweep: DataFrame, folds: Sequence[int]) -> DataFrame:
    """SET-5: fold scores side by side (``fold_<i>`` columns) plus the average."""
    wide = (sweep.groupBy("threshold_idx", "threshold").pivot("fold", list(folds))
                 .agg(F.first("roc_auc")))
    wide = wide.select("threshold_idx", "threshold", *[F.col(str(f)).alias(f"fold_{f}") for f in folds])
    avg = threshold_avg(sweep)
    return wide.join(avg, on=["threshold_idx", "threshold"], how="inner")


# ---------------------------------------------------------------- SWP-1, 2
def sweep_performance(df: DataFrame, id_col: str, label: str, score: str,
                      seeds: Sequence[int], ratios: Sequence[float], thresh: float = 0.5,
                      as_coded: bool = False) -> DataFrame:
    """SWP-1: the metric record of ``score`` on the test part of every
    (seed, split_ratio) split, computed as one job."""
    from wideflow.operators.split import sweep_test_counts
    counts = sweep_test_counts(df, id_col, label, score, seeds, ratios)
    return performance_from_counts(counts, thresh, ["seed", "split_ratio"], as_coded)


SWEEP_METRICS = ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1_score", "auc", "pr_auc")


def sweep_average(sweep: DataFrame, by=("split_ratio",)) -> DataFrame:
    """SWP-2: mean and population std of every metric per group."""
    g = _by(by)
    aggs = []
    for m in SWEEP_METRICS:
        aggs.append(F.avg(F.col(m).cast("double")).alias(f"{m}_mean"))
        aggs.append(F.stddev_pop(F.col(m).cast("double")).alias(f"{m}_std"))
    return sweep.groupBy(*g).agg(F.count(F.lit(1)).alias("n_runs"), *aggs)
