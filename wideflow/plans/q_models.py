"""Registered queries: models (MDL), search (HPO), cross-validation (CV),
score tables (SCO, AGG-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wideflow.operators import evaluate as ev
from wideflow.operators import impute as im
from wideflow.operators import models as md
from wideflow.operators import split as sp
from wideflow.operators.scale import MinMaxModel
from wideflow.plans.common import auc_sql, md5_sql, obs, with_obs
from wideflow.session import materialize, release

Q: dict = {}
SQL: dict = {}


def _q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


LABEL = "y_signal"
FEATS = ["n_lines", "l_q", "r_q", "l_p", "r_p", "l_d", "r_d", "sbp", "dbp", "bmi", "lab"]


def prepared(spark, sf, features=FEATS, k: int = 5):
    """obs -> label present -> mean fill -> stratified split (0.2, seed 11)
    -> min-max scale fitted on train -> 5 stratified folds inside each split,
    stored for the models of the query; readers scale as they read."""
    # Filling and ranking read their input several times, so it is stored.
    raw = materialize(obs(spark, sf).where(F.col(LABEL).isNotNull()).select("id", LABEL, *features))
    filled = im.fill(raw, list(features), "mean")
    d = materialize(sp.stratified_split_kfold(filled, "id", LABEL, 0.2, k, 11))
    release(raw)
    scaler = MinMaxModel.fit(d.where(F.col("split") == "train"), list(features))
    return scaler.transform(d).withColumn(LABEL, F.col(LABEL).cast("double"))


def _fit_predict(spark, sf, kind, params, features=FEATS):
    d = prepared(spark, sf, features)
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    if callable(params):
        params = params(train)
    model = md.make_model(kind, features, LABEL, params, seed=11).fit(train)
    return md.predict(model, test).select("id", LABEL, md.P1, "prediction")


@_q("model_lr")
def q_model_lr(spark, sf):
    """MDL-1: L2 logistic regression, C = 1 (regParam = 1 / (C n))."""
    return _fit_predict(spark, sf, "lr", lambda train: {"regParam": md.lr_reg_param(1.0, train.count()),
                                                        "elasticNetParam": 0.0})


@_q("model_rf")
def q_model_rf(spark, sf):
    """MDL-2: random forest (30 trees, depth 8, sqrt features)."""
    return _fit_predict(spark, sf, "rf", {"numTrees": 30, "maxDepth": 8, "featureSubsetStrategy": "sqrt"})


@_q("model_gbt")
def q_model_gbt(spark, sf):
    """MDL-3: second-order boosted trees, a point of the reference's space (100
    rounds, rate 0.1, depth 3, 0.8 of the columns per tree)."""
    from wideflow.operators import oof
    from wideflow.operators.boost import Boosting
    d = prepared(spark, sf)
    train = oof.assembled(d.where("split = 'train'"), FEATS, ["id", LABEL])
    test = oof.assembled(d.where("split = 'test'"), FEATS, ["id", LABEL])
    model = Boosting(LABEL, rounds=100, rate=0.1, depth=3, colsample=0.8).fit(train)
    return md.positive_score(model.transform(test)).select("id", LABEL, md.P1, "prediction")


@_q("model_mlp")
def q_model_mlp(spark, sf):
    """MDL-4: feed-forward network, 100 rectified units, Adam, samples of a
    quarter of the rows (at least 200), until the loss stays."""
    from wideflow.operators import oof
    from wideflow.operators.network import Network
    d = prepared(spark, sf)
    train = oof.assembled(d.where("split = 'train'"), FEATS, ["id", LABEL])
    test = oof.assembled(d.where("split = 'test'"), FEATS, ["id", LABEL])
    batch = max(200, train.count() // 4)
    model = Network(LABEL, hidden=100, batch=batch, rate=0.02, epochs=2000, tol=1e-3).fit(train)
    return md.positive_score(model.transform(test)).select("id", LABEL, md.P1, "prediction")


@_q("model_stacking")
def q_model_stacking(spark, sf):
    """MDL-5: the reference's four bases (LR, RF, ANN, XGB), each at a point of its
    search space, out-of-fold scores of 5 folds, final LR with C = 1."""
    from wideflow.operators.boost import Boosting
    from wideflow.operators.network import Network
    d = prepared(spark, sf)
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    rows = train.count()
    bases = {"lr": md.make_estimator("lr", LABEL, {"regParam": md.lr_reg_param(1.0, max(rows, 1))}),
             "rf": md.make_estimator("rf", LABEL, {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "sqrt"}),
             "mlp": Network(LABEL, hidden=100, batch=max(200, rows // 4), rate=0.02, epochs=2000, tol=1e-3),
             "gbt": Boosting(LABEL, rounds=100, rate=0.1, depth=3, colsample=0.8)}
    model = md.StackingClassifier(bases, LABEL, "fold", features=FEATS, c=1.0).fit(train)
    return model.transform(test).select("id", LABEL, md.P1, "prediction")


@_q("hpo_search")
def q_hpo_search(spark, sf):
    """HPO-1: 50 trials over the reference's space of logistic regressions, 5-fold
    AUC per trial."""
    from wideflow.operators.search import search
    from wideflow.plans.runs import SPACES
    d = md.balanced_weights(prepared(spark, sf).where(F.col("split") == "train"), LABEL)
    return search("lr", SPACES["lr"], d, FEATS, LABEL, "fold", n_iter=50, seed=11)[1]


@_q("cv_score")
def q_cv_score(spark, sf):
    """CV-1: refit on 4 folds, score the 5th, on the train split."""
    d = prepared(spark, sf).where(F.col("split") == "train")
    return md.cv_scores(md.make_model("lr", FEATS, LABEL, {"regParam": 1e-4}), d, LABEL, "fold")


@_q("model_lr_prevalence", with_obs(
    "SELECT id, (SELECT ROUND(AVG(CAST(y_signal AS DOUBLE)), 4) FROM obs WHERE y_signal IS NOT NULL) AS p1 "
    "FROM obs WHERE y_signal IS NOT NULL"))
def q_model_lr_prevalence(spark, sf):
    """MDL-1 and PRJ-11 where the answer is known: under a large L1 penalty all
    weights are zero and the probability is the share of positives."""
    d = obs(spark, sf).where(F.col(LABEL).isNotNull()).select(
        "id", F.col(LABEL).cast("double").alias(LABEL), "bmi", F.col("sex").cast("double").alias("sex"))
    model = md.make_model("lr", ["bmi", "sex"], LABEL, {"regParam": 100.0, "elasticNetParam": 1.0, "tol": 1e-12}).fit(d)
    return md.predict(model, d).select("id", F.round(md.P1, 4).alias("p1"))


@_q("model_rf_stump", with_obs(
    "SELECT o.id, ROUND(g.p, 6) AS p1 FROM obs o JOIN (SELECT n_lines > 4 AS many, AVG(CAST(y_signal AS DOUBLE)) AS p "
    "FROM obs WHERE y_signal IS NOT NULL AND n_lines IS NOT NULL GROUP BY n_lines > 4) g "
    "ON (o.n_lines > 4) = g.many WHERE o.y_signal IS NOT NULL"))
def q_model_rf_stump(spark, sf):
    """MDL-2 where the answer is known: one tree of depth 1, without bootstrap,
    on a 0/1 feature gives the share of positives on each side."""
    d = obs(spark, sf).where(F.col(LABEL).isNotNull() & F.col("n_lines").isNotNull()).select(
        "id", F.col(LABEL).cast("double").alias(LABEL), (F.col("n_lines") > 4).cast("double").alias("many"))
    model = md.make_model("rf", ["many"], LABEL, {"numTrees": 1, "maxDepth": 1, "bootstrap": False,
                                                 "minInfoGain": 0.0}).fit(d)
    return md.predict(model, d).select("id", F.round(md.P1, 6).alias("p1"))


@_q("positive_prob")
def q_positive_prob(spark, sf):
    """PRJ-11: class-1 probability out of a fitted model's vector."""
    return _fit_predict(spark, sf, "lr", {"regParam": 1e-4}).select("id", md.P1)


# ------------------------------------------------------------------ exact score tables
SCORES = ["n_lines", "sbp", "bmi"]


def _fold_scores(spark, sf):
    """Fold AUCs of three fixed scores, 5 stratified folds inside each split."""
    d = obs(spark, sf).where(F.col(LABEL).isNotNull()).select("id", LABEL, *SCORES)
    d = sp.stratified_split(d, "id", LABEL, 0.2, 11)
    tr = sp.stratified_kfold(d.where(F.col("split") == "train"), "id", LABEL, 5, 11)
    te = sp.stratified_kfold(d.where(F.col("split") == "test"), "id", LABEL, 5, 11)
    d = materialize(tr.unionByName(te))
    long = d.select("split", "fold", LABEL, F.explode(F.array(*[
        F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("score")) for s in SCORES])).alias("m")
    ).select("split", "fold", LABEL, "m.*")
    return ev.roc_auc(long, LABEL, "score", by=["split", "model", "fold"])


def _fold_scores_sql() -> list[str]:
    from wideflow.plans.common import alloc_sql, ratios_sql
    unions = " UNION ALL ".join(f"SELECT f.split, f.fold, f.y_signal, '{s}' AS model, CAST(o.{s} AS DOUBLE) AS score "
                                f"FROM f JOIN obs o ON f.id = o.id" for s in SCORES)
    return [
        "base AS (SELECT id, y_signal FROM obs WHERE y_signal IS NOT NULL)",
        ratios_sql([0.2]), *alloc_sql("base", "y_signal"),
        "spl AS (SELECT r.id, r.y_signal, CASE WHEN r.rk <= a.n_train THEN 'train' ELSE 'test' END AS split FROM "
        "(SELECT id, y_signal, ROW_NUMBER() OVER (PARTITION BY y_signal ORDER BY " + md5_sql("11", "id")
        + ", id) AS rk FROM base) r JOIN alloc a ON r.y_signal = a.y)",
        "rk AS (SELECT id, y_signal, split, ROW_NUMBER() OVER (PARTITION BY split, y_signal ORDER BY "
        + md5_sql("11", "id") + ", id) AS rk FROM spl)",
        "offs AS (SELECT split, y_signal, COALESCE(SUM(c) OVER (PARTITION BY split ORDER BY y_signal ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT split, y_signal, COUNT(*) AS c FROM spl "
        "GROUP BY split, y_signal) x)",
        "f AS (SELECT r.id, r.y_signal, r.split, CAST((o.off + r.rk - 1) % 5 AS INTEGER) AS fold FROM rk r "
        "JOIN offs o ON r.split = o.split AND r.y_signal = o.y_signal)",
        f"lng AS ({unions})",
        "cnt AS (SELECT split, model, fold, score, CAST(COUNT(*) FILTER (WHERE y_signal = 1) AS BIGINT) AS pos, "
        "CAST(COUNT(*) FILTER (WHERE y_signal <> 1) AS BIGINT) AS neg FROM lng WHERE score IS NOT NULL "
        "GROUP BY split, model, fold, score)",
        *auc_sql("cnt", ["split", "model", "fold"], "fa"),
    ]


@_q("cv_summary", with_obs(
    "SELECT split, model, ROUND(AVG(auc), 6) AS mean, ROUND(STDDEV_POP(auc), 6) AS std FROM fa GROUP BY split, model",
    *_fold_scores_sql()))
def q_cv_summary(spark, sf):
    """AGG-7: mean and population std of fold AUCs, 6 decimals."""
    return md.score_summary(_fold_scores(spark, sf), "auc", by=["split", "model"])


_SCORE_ROWS_SQL = """SELECT a.model, a.mean AS train_auc, a.std AS train_std, b.mean AS test_auc, b.std AS test_std,
       format('{:.6f}', a.mean) AS train_auc_text, format('{:.6f}', a.std) AS train_std_text,
       format('{:.6f}', b.mean) AS test_auc_text, format('{:.6f}', b.std) AS test_std_text
     FROM (SELECT model, ROUND(AVG(auc), 6) AS mean, ROUND(STDDEV_POP(auc), 6) AS std FROM fa
           WHERE split = 'train' GROUP BY model) a
     JOIN (SELECT model, ROUND(AVG(auc), 6) AS mean, ROUND(STDDEV_POP(auc), 6) AS std FROM fa
           WHERE split = 'test' GROUP BY model) b ON a.model = b.model"""


def _score_table(spark, sf):
    fs = _fold_scores(spark, sf)
    return md.score_rows(fs.where(F.col("split") == "train"), fs.where(F.col("split") == "test"))


@_q("score_rows", with_obs(_SCORE_ROWS_SQL, *_fold_scores_sql()))
def q_score_rows(spark, sf):
    """SCO-1: (model, train mean/std, test mean/std) with 6-decimal text."""
    return _score_table(spark, sf)


@_q("best_model", with_obs(f"SELECT * FROM ({_SCORE_ROWS_SQL}) s ORDER BY test_auc DESC, model LIMIT 1",
                           *_fold_scores_sql()))
def q_best_model(spark, sf):
    """SCO-2: the model with the highest test AUC."""
    return md.best_model(_score_table(spark, sf))


MANUAL = ["n_lines", "sbp", "dbp", "bmi"]


@_q("scored_run")
def q_scored_run(spark, sf):
    """One of the 25 scored runs at the reference's settings: manual feature set x
    logistic regression (50 search trials), scored by 5-fold CV on train and
    inside test."""
    from wideflow.plans.runs import RunStore, ScoredRuns
    from wideflow.session import scratch_path
    d = prepared(spark, sf)
    runs = ScoredRuns(RunStore(spark, scratch_path(spark)), d.where(F.col("split") == "train"),
                      d.where(F.col("split") == "test"), FEATS, LABEL, "id", manual=MANUAL)
    return runs.run("manual", "lr")
