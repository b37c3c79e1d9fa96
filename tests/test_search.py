import json
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from wideflow.operators import models as md
from wideflow.operators import search as hs
from wideflow.operators import split as sp

SPACE = {"x": (0.0, 10.0), "n": (1, 40, "int"), "c": ["a", "b", "c", "d", "e", "f"], "w": [None, "balanced"]}


def height(p):
    return -((p["x"] - 7.3) / 10) ** 2 - ((p["n"] - 31) / 40) ** 2 - 0.3 * (p["c"] != "d") - 0.1 * (p["w"] is None)


def test_finds_a_known_optimum_better_than_random_draws():
    found, drawn = [], []
    for seed in range(12):
        trials = hs.optimise(lambda ps: [height(p) for p in ps], SPACE, 50, seed, batch=4)
        assert len(trials) == 50
        found.append(hs.best_of(trials))
        drawn.append(max(height({k: hs.at(d, hs.uniform(seed, t, k)) for k, d in SPACE.items()}) for t in range(50)))
    heights = [height(p) for p in found]                     # negative, 0 at the optimum
    assert np.median(heights) > 0.1 * np.median(drawn) and np.mean(heights) > np.mean(drawn)
    assert sum(p["c"] == "d" and p["w"] == "balanced" for p in found) >= 9


def test_trials_are_fixed_by_the_seed_and_none_is_scored_twice():
    seen = []

    def evaluate(ps):
        seen.extend(hs.canonical(p) for p in ps)
        return [height({"x": 7.3, "n": 31, **p}) for p in ps]

    space = {"c": SPACE["c"], "w": SPACE["w"]}
    a = hs.optimise(evaluate, space, 50, 11, batch=4)
    assert len(seen) == len(set(seen)) <= 12
    assert a == hs.optimise(evaluate, space, 50, 11, batch=4)
    assert hs.best_of(a) == {"c": "d", "w": "balanced"}


def test_values_stay_in_their_domains_and_failed_trials_do_not_win():
    trials = hs.optimise(lambda ps: [math.nan if p["x"] > 5 else p["x"] for p in ps], SPACE, 60, 3, batch=1)
    assert all(0 <= p["x"] < 10 and 1 <= p["n"] <= 40 and isinstance(p["n"], int) and p["c"] in SPACE["c"]
               for p, _ in trials)
    assert 3 < hs.best_of(trials)["x"] <= 5


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(0, 0.5, 300) > 0.8).astype(float)
    d = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                              "id long, a double, b double, y double")
    return sp.stratified_kfold(md.balanced_weights(d, "y"), "id", "y", 3, 11)


@pytest.mark.parametrize("kind,space,n", [
    ("lr", {"C": [0.1, 1.0, 10.0], "elasticNetParam": [0.0, 1.0], "class_weight": [None, "balanced"]}, 6),
    ("gbt", {"n_estimators": [3, 5], "max_depth": [1, 2], "subsample": (0.5, 1.0)}, 4),
    ("rf", {"numTrees": [3, 5], "class_weight": [None, "balanced"]}, 3)])
def test_search_over_models(df, kind, space, n):
    model, trials = hs.search(kind, space, df, ["a", "b"], "y", "fold", n_iter=n)
    rows = trials.orderBy("trial").collect()
    assert len(rows) == n and sum(r["best"] for r in rows) == 1
    best = next(r for r in rows if r["best"])
    assert best["mean_auc"] == max(r["mean_auc"] for r in rows) > 0.85
    params = json.loads(best["params"])
    if kind != "gbt":
        est = hs.estimator(kind, "y", params, 300, 2)
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler
        pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol=md.FEATURES_COL), est])
        again = [r["auc"] for r in md.cv_scores(pipe, df, "y", "fold").collect()]
        # a forest's bootstrap depends on how the rows are parted
        assert abs(np.mean(again) - best["mean_auc"]) < (1e-9 if kind == "lr" else 0.05)
    assert hasattr(model, "transform")
