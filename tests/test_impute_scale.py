"""IMP, SCL: fills, variants, iterative imputation, scaling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wideflow.operators import impute as im
from wideflow.operators.scale import MinMaxModel


@pytest.fixture
def gaps(spark):
    rows = [(1, 2.0, 1.0), (2, 2.0, None), (3, 1.0, 3.0), (4, 1.0, None), (5, 5.0, 4.0), (6, None, 2.0)]
    return spark.createDataFrame(rows, "id int, a double, b double")


def test_mode_tie_smallest_and_first(gaps):
    v = im.fill_values(gaps, ["a"], ["mode"])["mode"]["a"]
    assert v == 1.0
    first = im.fill_values(gaps, ["a"], ["mode"], tie="first", id_col="id")["mode"]["a"]
    assert first == 2.0


def test_median_exact_even(spark):
    d = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None)], "id int, a double")
    assert im.fill_values(d, ["a"], ["median"])["median"]["a"] == 3.0
    d2 = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 3, 3, 9])], "id int, a double")
    assert im.fill_values(d2, ["a"], ["median"])["median"]["a"] == 3.0


def test_fill_and_variants(gaps):
    out = {r["id"]: r["b"] for r in im.fill(gaps, ["b"], "mean").collect()}
    assert out[2] == pytest.approx(2.5) and out[1] == 1.0
    v = im.fill_variants(gaps, ["a", "b"])
    assert v.groupBy("variant").count().count() == 4
    none = v.where("variant = 'none'").where("b IS NULL").count()
    assert none == 2
    assert v.where("variant <> 'none'").where("a IS NULL OR b IS NULL").count() == 0


def test_all_missing_column_passes_through(spark):
    d = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "id int, a double, z double")
    out = im.fill(d, ["a", "z"], "median")
    assert out.where("z IS NOT NULL").count() == 0 and out.where("a IS NULL").count() == 0


def test_iterative_linear_closed_form(spark):
    # b = 2a + 1 exactly; missing b must be recovered by the linear round
    rows = [(i, float(i), 2.0 * i + 1.0) for i in range(1, 40)]
    rows += [(100, 7.5, None), (101, 20.25, None)]
    d = spark.createDataFrame(rows, "id int, a double, b double")
    out = im.IterativeImputer(["a", "b"], im.linear_estimator(), max_iter=5).fit_transform(d)
    got = {r["id"]: r["b"] for r in out.collect()}
    assert got[100] == pytest.approx(16.0, abs=1e-6) and got[101] == pytest.approx(41.5, abs=1e-6)
    assert got[5] == 11.0  # known values unchanged
    assert out.where("a IS NULL OR b IS NULL").count() == 0


def _gappy(spark, n=300, cols=5):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, cols)) @ rng.normal(size=(cols, cols)) + 3
    x[rng.random((n, cols)) < 0.15] = np.nan
    x[:, 0] = np.where(np.isnan(x[:, 0]), 1.5, x[:, 0])          # one complete column
    names = [f"c{i}" for i in range(cols)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return x, names, spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names))


def _rounds_by_rows(x, rounds):
    """Round-robin least squares, row by row, as the reference library goes about it."""
    gone = np.isnan(x)
    x = np.where(gone, np.nanmean(x, axis=0), x)
    order = sorted([j for j in range(x.shape[1]) if gone[:, j].any()], key=lambda j: gone[:, j].sum())
    for _ in range(rounds):
        for j in order:
            others = [k for k in range(x.shape[1]) if k != j]
            z = np.column_stack((np.ones(len(x)), x[:, others]))
            w = np.linalg.lstsq(z[~gone[:, j]], x[~gone[:, j], j], rcond=None)[0]
            x[gone[:, j], j] = z[gone[:, j]] @ w
    return x


@pytest.mark.parametrize("reg", [0.0, 0.05])
def test_linear_rounds_by_pattern_equal_rounds_by_rows(spark, monkeypatch, reg):
    x, names, d = _gappy(spark)
    run = lambda: im.IterativeImputer(names, im.linear_estimator(reg), max_iter=4, tol=0.0).fit(d)
    one = run()
    got = np.array([[r[c] for c in names] for r in one.fitted_.orderBy("id").collect()])
    assert one.n_iter == 4
    if not reg:
        assert np.allclose(got, _rounds_by_rows(x, 4), atol=1e-7)
    monkeypatch.setattr(im, "PATTERN_NUMBERS", 0)
    two = run()
    rows = np.array([[r[c] for c in names] for r in two.fitted_.orderBy("id").collect()])
    assert np.allclose(got, rows, atol=1e-7)
    again = np.array([[r[c] for c in names] for r in two.transform(d).orderBy("id").collect()])
    assert np.allclose(got, again, atol=1e-7)


def test_both_ways_stop_at_the_same_round(spark, monkeypatch):
    _, names, d = _gappy(spark, 120, 3)
    run = lambda: im.IterativeImputer(names, im.linear_estimator(), max_iter=10, tol=1e-2).fit(d).n_iter
    a = run()
    monkeypatch.setattr(im, "PATTERN_NUMBERS", 0)
    assert 1 < a < 10 and a == run()


def test_linear_imputation_of_many_columns(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 4))
    x = base @ rng.normal(size=(4, 30))
    x[rng.random(x.shape) < 0.02] = np.nan
    names = [f"c{i}" for i in range(30)]
    d = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                              "id int, " + ", ".join(f"{c} double" for c in names))
    out = im.IterativeImputer(names, im.linear_estimator(), max_iter=6).fit_transform(d)
    got = np.array([[r[c] for c in names] for r in out.orderBy("id").collect()])
    known = ~np.isnan(x)
    assert np.array_equal(got[known], x[known]) and not np.isnan(got).any()


def test_iterative_gbt_runs_and_keeps_known(spark):
    rows = [(i, float(i % 7), float(i % 5), None if i % 6 == 0 else float(i % 7 + i % 5)) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, a double, b double, c double")
    out = im.IterativeImputer(["a", "b", "c"], im.gbt_estimator(n_trees=5), max_iter=2).fit_transform(d)
    got = {r["id"]: r["c"] for r in out.collect()}
    assert all(got[i] == float(i % 7 + i % 5) for i in range(60) if i % 6)
    assert out.where("c IS NULL").count() == 0


def test_minmax_constant_column_and_test_rows(spark):
    train = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "id int, x double, k double")
    test = spark.createDataFrame([(3, 6.0, 7.0)], "id int, x double, k double")
    m = MinMaxModel.fit(train, ["x", "k"])
    tr = {r["id"]: (r["x"], r["k"]) for r in m.transform(train).collect()}
    assert tr == {1: (0.0, 0.0), 2: (1.0, 0.0)}
    te = m.transform(test).first()
    assert te["x"] == pytest.approx(2.0) and te["k"] == pytest.approx(2.0)


def test_fills_of_text_and_large_integers(spark):
    big = 9007199254740993
    rows = [(1, big, "a", 0.0), (2, big, "b", -0.0), (3, big - 1, "b", 1.0), (4, None, None, None)]
    d = spark.createDataFrame(rows, "id long, n long, t string, x double")
    for strategy in ("mode", "median", "mean"):
        out = {r["id"]: r for r in im.fill(d, ["n", "t", "x"], strategy).collect()}
        assert [out[i]["t"] for i in (1, 2, 3, 4)] == ["a", "b", "b", None]
    modes = {r["id"]: r for r in im.fill(d, ["n", "t", "x"], "mode").collect()}
    assert modes[4]["n"] == big and modes[3]["n"] == big - 1
    assert modes[4]["x"] == 0.0
    assert im.fill_variants(d, ["n", "t", "x"]).count() == 16
