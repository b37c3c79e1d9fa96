import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wideflow.operators import oof
from wideflow.operators import split as sp
from wideflow.plans import runs
from wideflow.plans.runs import RunStore, ScoredRuns

SPACES = {"lr": {"C": [0.1, 1.0], "class_weight": [None, "balanced"]},
          "rf": {"numTrees": [2, 4], "maxDepth": [2, 3]},
          "gbt": {"n_estimators": [2, 3], "max_depth": [1, 2], "subsample": (0.6, 1.0)},
          "mlp": {"hidden": [3], "max_iter": [20], "rate": [0.03], "activation": ["relu", "tanh"]}}


@pytest.fixture(scope="module")
def splits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 3))
    y = (x[:, 0] + 0.4 * x[:, 1] + rng.normal(0, 0.5, 260) > 0).astype(float)
    d = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                              "id long, a double, b double, c double, y double")
    d = sp.stratified_split(d, "id", "y", 0.4, 11)
    return [sp.stratified_kfold(d.where(F.col("split") == s).drop("split"), "id", "y", 2, 11) for s in ("train", "test")]


def make(spark, path, splits, **kw):
    return ScoredRuns(RunStore(spark, path), *splits, ["a", "b", "c"], "y", "id", manual=["a", "b"], n_iter=2,
                      spaces=SPACES, parallelism=2, **kw)


def test_a_broken_run_goes_on_where_it_stopped(spark, splits, monkeypatch):
    path = tempfile.mkdtemp(prefix="runs-")
    first = make(spark, path, splits)
    real, calls = oof.out_of_fold, []

    def breaks(*a, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*a, **kw)

    monkeypatch.setattr(oof, "out_of_fold", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        first.run("manual", "lr")
    assert first.store.built == ["features", "trials", "scores"]
    monkeypatch.setattr(oof, "out_of_fold", real)
    second = make(spark, path, splits)
    row = second.run("manual", "lr").first()
    assert second.store.built == ["scores"]                       # the test split's, no more
    third = make(spark, path, splits)
    assert third.run("manual", "lr").first() == row and third.store.built == []
    fresh = make(spark, tempfile.mkdtemp(prefix="runs-"), splits)
    assert fresh.run("manual", "lr").first() == row               # and the same as without a break
    # other rows are never served from the store
    other = make(spark, path, [splits[0].where("id > 5"), splits[1]])
    other.feature_set("base")
    assert other.store.built == ["features"]


def test_a_table_that_was_cut_off_is_written_again(spark):
    store = RunStore(spark, tempfile.mkdtemp(prefix="runs-"))
    build = lambda: spark.range(3).toDF("x")
    assert store.table("s", {"k": 1}, build).count() == 3
    folder = next(os.path.join(store.path, "s", d) for d in os.listdir(f"{store.path}/s"))
    os.remove(f"{folder}/_SUCCESS")
    assert store.table("s", {"k": 1}, build).count() == 3 and store.built == ["s", "s"]


def test_all_models_and_shared_stages(spark, splits):
    r = make(spark, tempfile.mkdtemp(prefix="runs-"), splits)
    out = {x["model"]: x for x in r.table(["manual"], runs.MODELS).collect()}
    assert set(out) == set(runs.MODELS) and {x["feature_set"] for x in out.values()} == {"manual"}
    assert all(0.5 < x["train_auc"] <= 1 and x["train_std"] is not None for x in out.values())
    # two splits for each model; the stack tunes nothing of its own
    assert [r.store.built.count(s) for s in ("features", "trials", "scores")] == [1, 4, 10]


def test_feature_sets(spark, splits):
    kinds = {s: [x["feature"] for x in runs.chosen_features(
        s, splits[0], ["a", "b", "c"], "y", "id", ["b", "zz"], trials=2, num_trees=3).orderBy("pos").collect()]
        for s in runs.FEATURE_SETS}
    assert kinds["base"] == ["a", "b", "c"] and kinds["manual"] == ["b"]
    assert all("a" in kinds[s] for s in ("rfe", "shadow", "lasso"))
    with pytest.raises(ValueError, match="unknown"):
        runs.chosen_features("none", splits[0], ["a"], "y", "id")
