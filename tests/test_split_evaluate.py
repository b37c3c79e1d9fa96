"""SPL, EVL, THR, SWP: exact allocation, folds, curves and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wideflow.operators import evaluate as ev
from wideflow.operators import split as sp


def labelled(spark, n=203, seed=5, pos_share=0.37):
    rnd = random.Random(seed)
    rows = [(i, 1 if rnd.random() < pos_share else 0, round(rnd.random(), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, s double"), rows


def test_split_sizes_follow_allocation(spark):
    d, rows = labelled(spark)
    n = len(rows)
    n1 = sum(r[1] for r in rows)
    for ratio in (0.2, 0.99, 0.125):
        out = sp.stratified_split(d, "id", "y", ratio, 11).groupBy("split", "y").count().collect()
        got = {(r["split"], r["y"]): r["count"] for r in out}
        n_test = math.ceil(ratio * n)
        n_train = n - n_test
        cont = {0: (n - n1) / n * n_train, 1: n1 / n * n_train}
        fl = {k: math.floor(v) for k, v in cont.items()}
        need = n_train - sum(fl.values())
        for k in sorted(cont, key=lambda k: (-(cont[k] - fl[k]), k))[:need]:
            fl[k] += 1
        assert got.get(("train", 0), 0) == fl[0] and got.get(("train", 1), 0) == fl[1]
        assert got.get(("test", 0), 0) + got.get(("test", 1), 0) == n_test


def test_split_is_seeded_and_deterministic(spark):
    d, _ = labelled(spark)
    a = {r["id"]: r["split"] for r in sp.stratified_split(d, "id", "y", 0.3, 7).collect()}
    b = {r["id"]: r["split"] for r in sp.stratified_split(d, "id", "y", 0.3, 7).collect()}
    c = {r["id"]: r["split"] for r in sp.stratified_split(d, "id", "y", 0.3, 8).collect()}
    assert a == b and a != c


def test_kfold_balance(spark):
    d, _ = labelled(spark)
    out = sp.stratified_kfold(d, "id", "y", 5, 11).groupBy("fold", "y").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in out if r["y"] == y]
        assert max(sizes) - min(sizes) <= 1
    tot = sp.stratified_kfold(d, "id", "y", 5, 11).groupBy("fold").count().collect()
    sizes = [r["count"] for r in tot]
    assert max(sizes) - min(sizes) <= 1


def pairwise_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_and_flip(spark):
    d, rows = labelled(spark)
    auc = ev.roc_auc(d, "y", "s").first()["auc"]
    assert auc == pytest.approx(pairwise_auc(rows), abs=1e-12)
    flip = ev.roc_auc(d.withColumn("s", -F.col("s")), "y", "s").first()["auc"]
    assert flip == pytest.approx(1 - auc, abs=1e-12)


def test_pr_auc_binary_score_anchored(spark):
    # score 0/1; precision at 1 = 2/3, recall 2/4; at 0: precision 4/8, recall 1
    rows = [(0, 1, 1.0), (1, 1, 1.0), (2, 0, 1.0), (3, 1, 0.0), (4, 1, 0.0), (5, 0, 0.0), (6, 0, 0.0), (7, 0, 0.0)]
    d = spark.createDataFrame(rows, "id long, y int, s double")
    got = ev.pr_auc(d, "y", "s").first()["pr_auc"]
    want = 0.5 * (1 + 2 / 3) / 2 + 0.5 * (2 / 3 + 0.5) / 2
    assert got == pytest.approx(want, abs=1e-12)


def test_roc_points_drop_collinear(spark):
    rows = [(0, 1, 0.9), (1, 1, 0.8), (2, 1, 0.7), (3, 0, 0.2)]
    d = spark.createDataFrame(rows, "id long, y int, s double")
    pts = sorted((r["fpr"], r["tpr"]) for r in ev.roc_points(d, "y", "s").collect())
    assert pts == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def test_confusion_and_rates_zero_division(spark):
    d = spark.createDataFrame([(0, 0, 0.1), (1, 1, 0.2)], "id long, y int, s double")
    r = ev.rates(ev.confusion(d, "y", "s", 0.5)).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 0, 1, 0)
    assert r["precision"] is None and r["f1_score"] is None and r["recall"] == 0.0
    coded = ev.rates(ev.confusion(d, "y", "s", 0.5), as_coded=True).first()["accuracy"]
    assert coded == pytest.approx(1 / 1)


def test_threshold_sweep_equals_brute_force(spark):
    d, rows = labelled(spark, n=150)
    d = sp.stratified_kfold(d, "id", "y", 3, 1)
    folds = {r["id"]: r["fold"] for r in d.collect()}
    sweep = {(r["fold"], r["threshold_idx"]): r["roc_auc"] for r in ev.threshold_sweep(d, "y", "s").collect()}
    assert len(sweep) == 3 * 980
    for idx in (0, 150, 389, 390, 391, 500, 979):
        t = 0.01 + idx * 0.001
        for f in range(3):
            fr = [(y, s) for i, y, s in rows if folds[i] == f]
            p = sum(1 for y, _ in fr if y == 1)
            n = len(fr) - p
            tp = sum(1 for y, s in fr if y == 1 and s > t)
            tn = sum(1 for y, s in fr if y == 0 and not s > t)
            assert sweep[(f, idx)] == pytest.approx((tp / p + tn / n) / 2, abs=1e-12)


def test_single_class_fold_is_null(spark):
    d = spark.createDataFrame([(0, 1, 0.3, 0), (1, 1, 0.6, 0), (2, 0, 0.2, 1), (3, 1, 0.9, 1)],
                              "id long, y int, s double, fold int")
    sw = ev.threshold_sweep(d, "y", "s")
    assert sw.where("fold = 0 AND roc_auc IS NOT NULL").count() == 0
    assert ev.best_threshold(ev.threshold_avg(sw)).count() == 1


def test_sweep_row_equals_single_split(spark):
    d, _ = labelled(spark)
    d = d.withColumn("pred", (F.col("s") > 0.5).cast("int"))
    sweep = ev.sweep_performance(d, "id", "y", "pred", [7], [0.25]).first()
    test = sp.stratified_split(d, "id", "y", 0.25, 7).where("split = 'test'")
    one = ev.binary_performance(test, "y", "pred", 0.5).first()
    for k in ("tn", "fp", "fn", "tp", "auc", "pr_auc", "accuracy"):
        assert sweep[k] == pytest.approx(one[k], abs=1e-12)


def test_histogram_density_integrates_to_one(spark):
    d, _ = labelled(spark)
    h = ev.score_histogram(d, "y", "s", 25).collect()
    for y in (0, 1):
        tot = sum(r["density"] * (r["bin_hi"] - r["bin_lo"]) for r in h if r["label"] == y)
        assert tot == pytest.approx(1.0)
