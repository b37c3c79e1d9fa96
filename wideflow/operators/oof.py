"""Out-of-fold score tables: one model per fold, scoring only the fold it has not seen.

A table has one row per (row id, model): id, label, fold, model, score.  It is
stored once and then read by the threshold sweep (THR), the metric records
(EVL), the cross-validated AUCs (CV-1) and stacking (MDL-5), so no model is
fitted twice for them.  The feature vector is assembled once; fits of different
folds and models run side by side, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideflow.operators import boost
from wideflow.operators import evaluate as ev
from wideflow.operators import models as md
from wideflow.operators import network
from wideflow.session import materialize

#: Fits that run at the same time.
PARALLEL = 4
COLUMNS = ["id", "label", "fold", "model", "score"]


def side_by_side(tasks: Sequence[Callable], parallelism: int = PARALLEL) -> list:
    """The results of the tasks, at most ``parallelism`` of them running."""
    if not tasks:
        return []
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda t: t(), tasks, chunksize=1)


def assembled(df: DataFrame, features: Sequence[str], keep: Sequence[str], gaps: bool = False) -> DataFrame:
    """The columns ``keep`` and the feature vector, stored once for all fits.
    Missing cells raise, or stay as NaN with ``gaps``."""
    asm = VectorAssembler(inputCols=list(features), outputCol=md.FEATURES_COL,
                          handleInvalid="keep" if gaps else "error")
    return materialize(asm.transform(df).select(*keep, md.FEATURES_COL), spread=True)


def out_of_fold(data: DataFrame, estimators: Mapping[str, object], id_col: str, label: str,
                fold: str = "fold", parallelism: int = PARALLEL) -> DataFrame:
    """The out-of-fold score table of ``estimators`` (name -> estimator on the
    column of assembled features) over ``data`` (see :func:`assembled`)."""
    return both_ways(data, estimators, id_col, label, fold, parallelism, whole=False)[0]


def both_ways(data: DataFrame, estimators: Mapping[str, object], id_col: str, label: str, fold: str = "fold",
              parallelism: int = PARALLEL, whole: bool = True) -> tuple[DataFrame, dict]:
    """The out-of-fold score table, and name -> model fitted on all rows, with all of
    these fits in one call: those that learn in lock step share their passes."""
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())
    jobs = [(n, k) for n in estimators for k in [*folds, *([None] if whole else [])]]
    models = dict(zip(jobs, fit_jobs(data, [(estimators[n], k) for n, k in jobs], fold, parallelism), strict=True))
    scores = materialize(reduce(DataFrame.unionByName, [
        _scored(m, data.where(F.col(fold) == k), n, id_col, label, fold) for (n, k), m in models.items()
        if k is not None]))
    return scores, {n: models[n, None] for n in estimators} if whole else {}


def fit_jobs(data: DataFrame, jobs: Sequence[tuple[object, int | None]], fold: str | None = None,
             parallelism: int = PARALLEL) -> list:
    """One model per job (estimator, the fold it leaves out or None): boosted
    trees, and networks, learn in lock step over one store; others are fitted side
    by side."""
    out: list = [None] * len(jobs)
    for kind, fit_many in ((boost.Boosting, boost.fit_many), (network.Network, network.fit_many)):
        own = [i for i, (e, _) in enumerate(jobs) if isinstance(e, kind)]
        for i, m in zip(own, fit_many(data, [jobs[i] for i in own], fold) if own else []):
            out[i] = m
    rest = [i for i in range(len(jobs)) if out[i] is None]

    def task(est, k):
        return lambda: est.fit(data if k is None else data.where(F.col(fold) != k))

    for i, m in zip(rest, side_by_side([task(*jobs[i]) for i in rest], parallelism), strict=True):
        out[i] = m
    return out


def fitted(data: DataFrame, estimators: Mapping[str, object], parallelism: int = PARALLEL) -> dict:
    """name -> model fitted on all of ``data``."""
    models = fit_jobs(data, [(e, None) for e in estimators.values()], None, parallelism)
    return dict(zip(estimators, models, strict=True))


def scores_of(models: Mapping[str, object], data: DataFrame, id_col: str, label: str,
              fold: str | None = None) -> DataFrame:
    """The score table of fitted models over ``data``: each scores every row."""
    return materialize(reduce(DataFrame.unionByName, [
        _scored(m, data, n, id_col, label, fold) for n, m in models.items()]))


def _scored(model, data, name, id_col, label, fold) -> DataFrame:
    k = F.lit(None).cast("int") if fold is None else F.col(fold)
    return md.positive_score(model.transform(data), "score").select(
        F.col(id_col).alias("id"), F.col(label).alias("label"), k.alias("fold"), F.lit(name).alias("model"), "score")


def fold_aucs(scores: DataFrame) -> DataFrame:
    """(model, fold, auc) of a score table, in one grouped job."""
    return ev.roc_auc(scores, "label", "score", by=["model", "fold"])


def tuned_thresholds(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """THR-1..3 on a score table: (by..., decision_threshold, avg_roc_auc), the
    grid threshold of the largest mean balanced AUC over the folds."""
    sweep = ev.threshold_sweep(scores, "label", "score", "fold", by=by)
    best = ev.best_threshold(ev.threshold_avg(sweep, by=by), by=by)
    return best.select(*by, F.col("threshold").alias("decision_threshold"), "avg_roc_auc")


def at_thresholds(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """EVL-11: the metric record of every model of a score table at its own
    threshold (``thresholds``: model, decision_threshold; one row per model)."""
    counts = ev.score_counts(scores, "label", "score", ["model"])
    limits = thresholds.select("model", F.col("decision_threshold").alias("__t"))
    rec = ev.performance_from_counts(counts.join(limits, "model"), F.col("__t"), ["model", "__t"])
    return rec.drop("__t")


def stack_features(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """id, label, fold and one score column per model: the final model's input."""
    wide = scores.groupBy("id", "label", "fold").pivot("model", list(names)).agg(F.first("score"))
    return wide.select("id", "label", "fold", *[F.col(n).alias(f"s_{n}") for n in names])

