import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from wideflow.operators import impute as im
from wideflow.plans import q_impute


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, [7, 12, 5], (400, 3)).astype(float)
    y = x[:, 0] * x[:, 1] - 3 * x[:, 2] + rng.normal(0, 2, 400)
    rows = [(i, *map(float, r), float(t) if i % 5 else None) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def test_trees_from_cell_sums_are_those_of_the_library(data):
    seen = data.where("y IS NOT NULL")
    x = np.array([[r[c] for c in "abcy"] for r in seen.orderBy("id").collect()])
    cuts = [im._cuts(*im._points(x[:, f], np.ones(len(x)), 99)) for f in range(3)]
    assert [len(c) for c in cuts] == [6, 11, 4]
    at = tuple(im._bins(x[:, :3], cuts).T)
    n, s = np.zeros((7, 12, 5)), np.zeros((7, 12, 5))
    np.add.at(n, at, 1)
    np.add.at(s, at, x[:, 3])
    got = im.BoostedFit("abc", cuts, im.boosted_cells(n, s, 12, 0.1, 3)).predict(x[:, :3])
    vec = VectorAssembler(inputCols=list("abc"), outputCol="x").transform(seen)
    want = GBTRegressor(featuresCol="x", labelCol="y", maxIter=12, stepSize=0.1, maxDepth=3).fit(vec).transform(vec)
    assert got == pytest.approx(np.array([r["prediction"] for r in want.orderBy("id").collect()]), abs=1e-9)


def test_imputer_needs_no_library_fit_unless_cells_are_many(data, monkeypatch):
    calls = []
    plain = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d: calls.append(1) or plain(self, d))
    run = lambda: {r["id"]: r["y"] for r in im.IterativeImputer(
        list("abcy"), im.gbt_estimator(n_trees=4), max_iter=3).fit_transform(data).collect()}
    few = run()
    assert not calls and len(few) == 400 and all(v is not None for v in few.values())
    monkeypatch.setattr(im, "TREE_CELLS", 10)
    many = run()
    assert calls and all(few[i] == pytest.approx(many[i], abs=1e-9) for i in few)


def test_quantile_cuts_a_constant_and_points_that_stand_for_many():
    v = np.arange(5000.0)
    cuts = im._cuts(*im._points(v, np.ones(5000), 5000))
    assert len(cuts) == 31 and np.abs(np.diff(cuts) - 5000 / 32).max() < 2
    assert len(im._cuts(*im._points(np.ones(9), np.ones(9), 50))) == 0
    value, weight = im._points(v, np.ones(5000), 100)
    assert len(value) <= 100 and weight.sum() == 5000 and value[-1] == 4999 and weight.max() <= 51


def test_query_has_the_reference_settings(spark, sf, monkeypatch):
    made = {}

    class Stop(Exception):
        pass

    def imputer(cols, estimator, max_iter, seed):
        made.update(cols=cols, boosted=estimator.boosted, max_iter=max_iter)
        raise Stop

    monkeypatch.setattr(im, "IterativeImputer", imputer)
    with pytest.raises(Stop):
        q_impute.q_impute_iterative(spark, sf)
    assert made == {"cols": q_impute.IMPUTE_COLS, "boosted": (100, 0.1, 3), "max_iter": 10}
