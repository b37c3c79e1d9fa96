import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wideflow.operators import evaluate as ev
from wideflow.operators import models as md
from wideflow.operators import oof
from wideflow.operators import split as sp


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.7, 400) > 0).astype(float)
    d = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                              "id long, a double, b double, c double, y double")
    return oof.assembled(sp.stratified_kfold(d, "id", "y", 4, 11), ["a", "b", "c"], ["id", "y", "fold", "a", "b", "c"])


@pytest.fixture(scope="module")
def models():
    return {"lr": md.make_estimator("lr", "y", {"regParam": 1e-3}),
            "rf": md.make_estimator("rf", "y", {"numTrees": 5, "maxDepth": 3})}


def test_each_row_is_scored_once_by_a_model_that_has_not_seen_it(data, models):
    got = oof.out_of_fold(data, models, "id", "y")
    assert got.columns == oof.COLUMNS and got.count() == 800
    assert got.select("id", "model").distinct().count() == 800
    for k in range(4):
        m = models["lr"].fit(data.where(F.col("fold") != k))
        want = {r["id"]: r["p1"] for r in md.positive_score(m.transform(data.where(F.col("fold") == k))).collect()}
        have = {r["id"]: r["score"] for r in got.where((F.col("fold") == k) & (F.col("model") == "lr")).collect()}
        assert have.keys() == want.keys() and all(abs(have[i] - want[i]) < 1e-9 for i in want)


def test_folds_fit_side_by_side_give_the_scores_of_one_after_another(data, models):
    a = oof.out_of_fold(data, models, "id", "y", parallelism=4)
    b = oof.out_of_fold(data, models, "id", "y", parallelism=1)
    assert a.exceptAll(b).count() == 0
    plain = md.cv_scores(md.make_model("lr", ["a", "b", "c"], "y", {"regParam": 1e-3}),
                         data.drop(md.FEATURES_COL), "y", "fold")
    one = {r["fold"]: r["auc"] for r in oof.fold_aucs(a).where("model = 'lr'").collect()}
    assert {r["fold"]: r["auc"] for r in plain.collect()} == pytest.approx(one)


def test_thresholds_of_the_stored_scores_equal_sql(data, models):
    scores = oof.out_of_fold(data, models, "id", "y")
    got = {r["model"]: (r["decision_threshold"], r["avg_roc_auc"]) for r in oof.tuned_thresholds(scores).collect()}
    con = duckdb.connect()
    con.register("s", scores.toPandas())
    want = con.execute("""
      WITH g AS (SELECT i, 0.01e0 + i * 0.001e0 AS t FROM (SELECT unnest(range(0, 980)) AS i) x),
      f AS (SELECT model, fold, i, t, (count(*) FILTER (label = 1 AND score > t) / count(*) FILTER (label = 1)
              + count(*) FILTER (label = 0 AND NOT score > t) / count(*) FILTER (label = 0)) / 2 AS a
            FROM s, g GROUP BY model, fold, i, t),
      v AS (SELECT model, i, t, avg(a) AS a FROM f GROUP BY model, i, t)
      SELECT model, t, a FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(a, 12) DESC, i) AS n FROM v) z
      WHERE n = 1""").fetchall()
    assert len(want) == 2
    for m, t, a in want:
        assert got[m] == pytest.approx((t, a))


def test_record_at_the_tuned_threshold(data, models):
    scores = oof.out_of_fold(data, models, "id", "y")
    limits = oof.tuned_thresholds(scores)
    rec = {r["model"]: r for r in oof.at_thresholds(scores, limits).collect()}
    for m, t in [(r["model"], r["decision_threshold"]) for r in limits.collect()]:
        one = ev.binary_performance(scores.where(F.col("model") == m).select("label", "score"), "label", "score", t).first()
        assert {c: rec[m][c] for c in one.asDict()} == pytest.approx(one.asDict())


def test_one_class_folds_and_missing_scores(spark):
    rows = [(i, float(i < 5), 0 if i < 5 else 1, "m", i / 10 if i != 3 else None) for i in range(10)]
    s = spark.createDataFrame(rows, "id long, label double, fold int, model string, score double")
    assert oof.tuned_thresholds(s).count() == 0             # no fold has both classes
    assert {r["auc"] for r in oof.fold_aucs(s).collect()} == {None}


def test_stack_features(data, models):
    wide = oof.stack_features(oof.out_of_fold(data, models, "id", "y"), ["lr", "rf"])
    assert wide.columns == ["id", "label", "fold", "s_lr", "s_rf"] and wide.count() == 400
    assert wide.where("s_lr IS NULL OR s_rf IS NULL").count() == 0


def test_stored_tables_leave_the_session_as_it_was(spark):
    from wideflow import session
    before = spark.conf.get(session.CLEANUP_CONF, None)
    t = session.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert t.count() == 7 and spark.conf.get(session.CLEANUP_CONF, None) == before
    both = oof.side_by_side([lambda i=i: session.materialize(spark.range(i + 1).distinct()).count() for i in range(6)], 3)
    assert both == [1, 2, 3, 4, 5, 6] and spark.conf.get(session.CLEANUP_CONF, None) == before
    with pytest.raises(Exception):
        session.materialize(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    assert spark.conf.get(session.CLEANUP_CONF, None) == before
