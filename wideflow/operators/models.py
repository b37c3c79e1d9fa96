"""MDL-1, 2, 4, 5, CV-1, SCO-1..2, AGG-7: Spark ML classifiers,
cross-validation, stacking and score tables (MDL-3 is in ``boost``, HPO-1 in ``search``).

Models are ``pyspark.ml`` pipelines (VectorAssembler + estimator); every fit
is a distributed job.  The driver only loops over folds, trials and base
models -- numbers bounded by the parameters, never by the data.  Scores are
exact ROC AUCs from ``evaluate`` (not ``BinaryClassificationEvaluator``'s
binned default).
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideflow.operators import evaluate as ev
from wideflow.operators.clean import positive_prob
from wideflow.session import materialize, release

FEATURES_COL = "__features"
P1 = "p1"


# ------------------------------------------------------------------ MDL-1..4
def lr_reg_param(C: float, n: int) -> float:
    """Map the reference library's inverse strength C to Spark's regParam
    (its loss is a sum, Spark's a mean): regParam = 1 / (C * n)."""
    return 1.0 / (C * n)


CLASS_WEIGHT = "class_weight"


def make_estimator(kind: str, label: str, params: Mapping | None = None, seed: int = 11,
                   n_features: int | None = None, weight_col: str | None = None):
    p = dict(params or {})
    if p.pop("class_weight", None) == "balanced":
        weight_col = weight_col or CLASS_WEIGHT
    common = dict(featuresCol=FEATURES_COL, labelCol=label)
    if kind == "lr":
        est = LogisticRegression(standardization=False, maxIter=p.pop("maxIter", 100), **common)
    elif kind == "rf":
        est = RandomForestClassifier(seed=seed, **common)
    elif kind == "gbt":
        est = GBTClassifier(seed=seed, **common)
    elif kind == "mlp":
        hidden = p.pop("hidden", 100)
        est = MultilayerPerceptronClassifier(seed=seed, layers=[n_features, hidden, 2], **common)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    if weight_col and kind in ("lr", "rf", "gbt"):
        est = est.setWeightCol(weight_col)
    for k, v in p.items():
        est = est._set(**{k: v})
    return est


def make_model(kind: str, features: Sequence[str], label: str, params: Mapping | None = None,
               seed: int = 11, weight_col: str | None = None) -> Pipeline:
    """MDL-1..4: assembler + classifier (lr, rf, gbt, mlp)."""
    asm = VectorAssembler(inputCols=list(features), outputCol=FEATURES_COL, handleInvalid="error")
    est = make_estimator(kind, label, params, seed, len(features), weight_col)
    return Pipeline(stages=[asm, est])


def balanced_weights(df: DataFrame, label: str, out: str = CLASS_WEIGHT) -> DataFrame:
    """``class_weight='balanced'``: n / (n_classes * n_class) per row, in the
    column that models with that parameter read."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    everything = Window.partitionBy()  # the class table: one row per class
    w = counts.select(label, (F.sum("__nc").over(everything)
                              / (F.count(F.lit(1)).over(everything) * F.col("__nc"))).alias(out))
    return df.join(w, on=label, how="left")  # w has one row per class


def positive_score(pred: DataFrame, out: str = P1) -> DataFrame:
    """Probability of class 1 (PRJ-11) from a fitted pipeline's output."""
    return positive_prob(pred, "probability", out)


def predict(model: PipelineModel, df: DataFrame, out: str = P1) -> DataFrame:
    return positive_score(model.transform(df), out).drop(FEATURES_COL, "rawPrediction", "probability")


# ------------------------------------------------------------------ CV-1
def fold_auc(pred: DataFrame, label: str, score: str = P1, by: Sequence[str] = ("fold",)) -> DataFrame:
    return ev.roc_auc(pred, label, score, by=list(by))


def cv_scores(pipeline: Pipeline, df: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """CV-1: (fold, auc): refit on the other folds, score the held-out fold.

    The features are assembled and stored once, the folds are fitted side by
    side, and the held-out scores are one table with one grouped AUC job.
    """
    from wideflow.operators import oof
    *prepare, est = pipeline.getStages()
    for stage in prepare:
        df = stage.transform(df)
    weight = est.getOrDefault("weightCol") if est.hasParam("weightCol") and est.isSet("weightCol") else None
    keep = [fold, label, FEATURES_COL, *([weight] if weight else [])]
    data = materialize(df.select(*keep).withColumn("__id", F.lit(None).cast("long")), spread=True)
    return oof.fold_aucs(oof.out_of_fold(data, {"": est}, "__id", label, fold)).select(
        F.col("fold").alias(fold), "auc")


def score_summary(scores: DataFrame, value: str = "auc", by: Sequence[str] = ("model",)) -> DataFrame:
    """AGG-7: mean and population std of fold scores, rounded to 6 decimals."""
    return scores.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"),
                                   F.round(F.stddev_pop(value), 6).alias("std"))


def score_rows(train: DataFrame, test: DataFrame, by: str = "model") -> DataFrame:
    """SCO-1: the score table (model, train mean/std, test mean/std); numeric
    columns plus the reference's 6-decimal text form."""
    a = score_summary(train, by=[by]).select(by, F.col("mean").alias("train_auc"), F.col("std").alias("train_std"))
    b = score_summary(test, by=[by]).select(by, F.col("mean").alias("test_auc"), F.col("std").alias("test_std"))
    j = a.join(b, on=by, how="full_outer")
    return j.select("*", *[F.format_number(c, 6).alias(f"{c}_text")
                           for c in ("train_auc", "train_std", "test_auc", "test_std")])


def best_model(scores: DataFrame, metric: str = "test_auc", by: str = "model") -> DataFrame:
    """SCO-2: the row with the highest test score (ties -> first name)."""
    return scores.orderBy(F.col(metric).desc_nulls_last(), F.col(by)).limit(1)


# ------------------------------------------------------------------ MDL-5
class StackingModel:
    """``bases``: fitted models on the column of assembled features."""

    def __init__(self, features, bases, final, names):
        self.features, self.bases, self.final, self.names = features, bases, final, names

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        return _final_score(self.final, _base_scores(self.features.transform(df), self.bases, self.names, kept), kept)


def _base_scores(data: DataFrame, bases: Sequence, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and ``__s_<name>``, the positive score of every base."""
    for i, (name, m) in enumerate(zip(names, bases, strict=True)):
        own = [F.col(c) for c in keep] + [F.col(f"__s_{n}") for n in names[:i]]
        data = positive_score(m.transform(data), f"__s_{name}").select(*own, FEATURES_COL, f"__s_{name}")
    return data.drop(FEATURES_COL)


def _final_score(final: PipelineModel, scores: DataFrame, keep: Sequence[str]) -> DataFrame:
    return predict(final, scores, P1).select(*keep, "prediction", P1)


class StackingClassifier:
    """MDL-5: out-of-fold base scores -> final logistic regression.

    For every fold the bases are fitted on the other folds and score the
    held-out fold; the union of held-out scores trains the final model.
    The bases are then refit on all rows for prediction.  A base is a pipeline
    (assembler + classifier), or an estimator on the column of assembled
    ``features`` (``Boosting``, ``Network``); ``c``: the final model's inverse penalty
    (none: not penalised).  The features are assembled and stored once; boosted
    trees, and networks, of all folds learn in lock step.
    """

    def __init__(self, bases: Mapping[str, object], label: str, fold: str = "fold", seed: int = 11,
                 features: Sequence[str] | None = None, c: float | None = None):
        self.label, self.fold, self.seed, self.c = label, fold, seed, c
        self.bases, lists = {}, [] if features is None else [list(features)]
        for name, base in dict(bases).items():
            if isinstance(base, Pipeline):
                asm, base = base.getStages()
                lists.append(asm.getInputCols())
            self.bases[name] = base
        if not lists or any(x != lists[0] for x in lists):
            raise ValueError("the bases of a stack need one list of features")
        self.features = VectorAssembler(inputCols=lists[0], outputCol=FEATURES_COL, handleInvalid="error")

    def fit(self, df: DataFrame) -> StackingModel:
        from wideflow.operators import oof
        names = list(self.bases)
        weights = [c for c in (CLASS_WEIGHT,) if c in df.columns]
        key = F.xxhash64(*[F.col(c) for c in df.columns]).alias("__key")          # tells rows apart when samples are drawn
        data = materialize(self.features.transform(df).select(self.label, self.fold, *weights, key, FEATURES_COL),
                           spread=True)
        folds = sorted(r[0] for r in data.select(self.fold).distinct().collect())
        jobs = [(n, k) for n in names for k in [*folds, None]]
        fitted = dict(zip(jobs, oof.fit_jobs(data, [(self.bases[n], k) for n, k in jobs], self.fold), strict=True))
        scores = materialize(reduce(DataFrame.unionByName, [
            _base_scores(data.where(F.col(self.fold) == k), [fitted[n, k] for n in names], names, [self.label])
            for k in folds]))
        release(data)
        params = {} if self.c is None else {"regParam": lr_reg_param(self.c, max(scores.count(), 1))}
        final = make_model("lr", [f"__s_{n}" for n in names], self.label, params, seed=self.seed).fit(scores)
        release(scores)
        return StackingModel(self.features, [fitted[n, None] for n in names], final, names)
