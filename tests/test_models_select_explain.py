"""MDL/CV/HPO/stacking smoke, FS closed forms, XPL additivity, IO round trips."""

import math
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wideflow.operators import explain as xp
from wideflow.operators import models as md
from wideflow.operators import selection as se
from wideflow.operators import split as sp
from wideflow.sources import io


@pytest.fixture(scope="module")
def signal(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        a, b, c = rnd.random(), rnd.random(), rnd.random()
        y = 1 if a + 0.3 * b + 0.1 * rnd.random() > 0.75 else 0
        rows.append((i, a, b, c, float(y)))
    d = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    return sp.stratified_kfold(d, "id", "y", 3, 11).cache()


def test_models_learn_signal(signal):
    for kind, params in [("lr", {"regParam": 1e-3}), ("rf", {"numTrees": 10, "maxDepth": 4}),
                         ("gbt", {"maxIter": 10, "maxDepth": 3}), ("mlp", {"hidden": 4, "maxIter": 50})]:
        scores = md.cv_scores(md.make_model(kind, ["a", "b", "c"], "y", params), signal, "y", "fold")
        mean = scores.agg(F.avg("auc")).first()[0]
        assert mean > 0.8, (kind, mean)


def test_stacking(signal):
    bases = {"lr": md.make_model("lr", ["a", "b", "c"], "y", {"regParam": 1e-3}),
             "rf": md.make_model("rf", ["a", "b", "c"], "y", {"numTrees": 5})}
    st = md.StackingClassifier(bases, "y", "fold").fit(signal)
    out = st.transform(signal)
    assert out.where("p1 IS NULL").count() == 0


def test_score_rows_population_std(spark):
    s = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 0.7)], "model string, fold int, auc double")
    row = md.score_rows(s, s).first()
    assert row["train_auc"] == 0.6 and row["train_std"] == pytest.approx(0.1)
    assert row["test_auc_text"] == "0.600000"


def test_lasso_one_feature_closed_form(spark):
    rnd = random.Random(1)
    rows = [(i, x, 3.0 * x + rnd.gauss(0, 0.1), i % 5) for i, x in enumerate(rnd.random() for _ in range(200))]
    d = spark.createDataFrame(rows, "id long, x double, y double, fold int")
    g = se.gram_stats(d, ["x"], "y", "fold")
    S = se._stats_arrays(g.collect(), ["x"])
    total = sum(S.values())
    G, c, mx, my = se._centered(total, 1)
    for alpha in (0.0, 0.01, 0.05):
        w = se._cd(G, c, alpha, np.zeros(1))
        want = math.copysign(max(abs(c[0]) - alpha, 0.0), c[0]) / G[0, 0]
        assert w[0] == pytest.approx(want, rel=1e-9, abs=1e-12)
    alpha, w, path = se.lasso_cv(g, ["x"])
    assert len(path) == 100 and w[0] > 2.5


def test_contiguous_folds(spark):
    d = spark.createDataFrame([(i * 3,) for i in range(23)], "id long")
    f = [r["fold"] for r in se.contiguous_folds(d, "id", 5).orderBy("id").collect()]
    assert f == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4


def test_hit_test_binomial(spark):
    hits = spark.createDataFrame([(t, "f", 1) for t in range(10)] + [(t, "g", 0) for t in range(10)]
                                 + [(t, "h", t % 2) for t in range(10)], "trial int, feature string, hit int")
    out = {r["feature"]: r for r in se.hit_test(hits).collect()}
    assert out["f"]["p_accept"] == pytest.approx(3 * 0.5 ** 10) and out["f"]["decision"] == "accepted"
    assert out["g"]["decision"] == "rejected" and out["h"]["decision"] == "tentative"


def test_rfe_paths(signal):
    g = se.rfe_cv_gram(signal, ["a", "b", "c"], "y", "fold").collect()
    assert sorted(r["n_features"] for r in g) == [1, 2, 3]
    best = [r for r in g if r["selected"]][0]
    assert "a" in best["features"]


def test_shapley_additivity_on_model(signal):
    model = md.make_model("lr", ["a", "b", "c"], "y", {"regParam": 1e-3}).fit(signal)
    pf = xp.model_predictor(model, "p1")
    bg = xp.background(signal, "id", ["a", "b", "c"], 5)
    rows = signal.where("id < 20")
    phi = xp.shapley_values(pf, rows, "id", ["a", "b", "c"], bg, n_perm=2)
    tot = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    fx = {r["id"]: r["__f"] for r in pf(rows).select("id", "__f").collect()}
    bgdf = signal.sparkSession.createDataFrame([tuple(b) for b in bg], "a double, b double, c double")
    fb = pf(bgdf.withColumn("id", F.lit(0))).agg(F.avg("__f")).first()[0]
    for i in tot:
        assert tot[i] == pytest.approx(fx[i] - fb, abs=1e-9)


def test_pdp_linear(spark):
    d = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(10)], "id long, a double, b double")
    pd_ = xp.partial_dependence(xp.linear_predictor({"a": 2.0, "b": 1.0}), d, "a", [0.0, 1.0])
    got = {r["grid_value"]: r["average"] for r in pd_.collect()}
    assert got == {0.0: pytest.approx(9.0), 1.0: pytest.approx(11.0)}
    assert xp.pdp_grid(d, "a") == [float(i) for i in range(10)]


def test_io_round_trip_and_variants(spark):
    base = tempfile.mkdtemp(prefix="wideflow-io-")
    d = spark.createDataFrame([(1, float("nan"), "a"), (2, 2.0, "b")], "id int, x double, v string")
    io.write_table(d, base + "/t")
    back = io.read_table(spark, base + "/t")
    assert {r["id"]: r["x"] for r in back.collect()} == {1: None, 2: 2.0}
    io.write_table(d.withColumnRenamed("v", "variant"), base + "/v", partition_by=["variant"])
    assert io.read_variant(spark, base + "/v", "b").count() == 1
    assert io.read_variants(spark, base + "/v").count() == 2
    io.write_table(d, base + "/c", fmt="csv")
    assert io.read_table(spark, base + "/c", fmt="csv").count() == 2


def test_rfe_svm_form(signal):
    out = se.rfe_cv(signal, ["a", "b", "c"], "y", "fold").collect()
    assert sorted(r["n_features"] for r in out) == [1, 2, 3]
    assert sum(1 for r in out if r["selected"]) == 1


def test_shapley_of_additive_scores_without_perturbed_rows(spark, signal):
    """A linear score is explained inside the tasks: the same values as the general
    way, rows of one id together, gaps included, and no row per perturbation."""
    feats = ["a", "b", "c"]
    bg = xp.background(signal, "id", feats, 7)
    model = md.make_model("lr", feats, "y", {"regParam": 1e-3}).fit(signal)
    gaps = spark.createDataFrame([(1, 0.5, None, 2.0), (1, 1.0, 2.0, 3.0), (2, None, None, None), (None, 1.0, 0.0, 4.0)],
                                 "id long, a double, b double, c double")
    rows = signal.where("id < 30")
    for pf, d in ((xp.linear_predictor({"a": 0.5, "c": -2.0}, 1.0), gaps), (xp.linear_predictor({"b": 3.0}), rows),
                  (xp.model_predictor(model, "prediction"), rows), (xp.model_predictor(model, "p1"), rows)):
        assert pf.additive is not None
        fast = xp.shapley_values(pf, d, "id", feats, bg, 2)
        assert "Generate" not in fast._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
        slow = xp.shapley_values(lambda x, pf=pf: pf(x), d, "id", feats, bg, 2)
        one, two = ({(r["id"], r["feature"]): r["phi"] for r in t.collect()} for t in (fast, slow))
        assert one.keys() == two.keys()
        for k, v in two.items():
            assert one[k] == (None if v is None else pytest.approx(v, abs=1e-12))
    with pytest.raises(Exception, match="missing cells"):
        xp.shapley_values(xp.model_predictor(model, "p1"), gaps, "id", feats, bg, 2).collect()


def test_shadow_aucs_in_batches_of_trials(spark, monkeypatch):
    """Groups, label blocks and batches smaller than the table change nothing: every
    trial's AUCs are those of the rows matched by rank, ties and gaps included."""
    import hashlib
    monkeypatch.setattr(se, "COPIES_AT_ONCE", 130)
    monkeypatch.setattr(se, "GROUP_ROWS", 4)
    monkeypatch.setattr(se, "BLOCK", 16)
    rnd = random.Random(7)
    rows = [(i * 7, rnd.choice([0, 0, 1, None]), rnd.choice([1.0, 2.0, 3.0, None]), rnd.random()) for i in range(60)]
    stored = []
    monkeypatch.setattr(se, "materialize", lambda d, *a, _m=se.materialize, **k: stored.append(d.columns) or _m(d, *a, **k))
    got = {(r["trial"], r["feature"]): r for r in se.auc_shadow_hits(
        spark.createDataFrame(rows, "id long, y int, a double, b double"), "id", ["a", "b"], "y", 5, 11).collect()}
    assert len(got) == 10 and stored.count(["trial", "i", "r2", "pos", "n"]) == 3
    known = sorted(r for r in rows if r[1] is not None)

    def auc(pairs):
        pos, neg = ([v for y, v in pairs if y == k and v is not None] for k in (1, 0))
        return abs(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)) - 0.5)

    for t in range(5):
        moved = sorted(known, key=lambda r: hashlib.md5(f"11:{t}:{r[0]}".encode()).hexdigest())
        want = max(auc([(k[1], m[c]) for k, m in zip(known, moved)]) for c in (2, 3))
        for c, f in ((2, "a"), (3, "b")):
            assert got[t, f]["max_shadow"] == pytest.approx(want, abs=1e-12)
            assert got[t, f]["importance"] == pytest.approx(auc([(k[1], k[c]) for k in known]), abs=1e-12)
            assert got[t, f]["hit"] == int(got[t, f]["importance"] > got[t, f]["max_shadow"])
