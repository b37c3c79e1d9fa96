"""FLG, PRJ: boundary rows and missing-value rules on hand tables."""

import pytest
from pyspark.sql import functions as F

from wideflow.operators import flags as fl
from wideflow.operators import measures as ms


def rows(df, col, key="k"):
    return {r[key]: r[col] for r in df.collect()}


def test_band_flag_boundaries(spark):
    d = spark.createDataFrame(
        [(1, 119.0, 79.0), (2, 120.0, 70.0), (3, 140.0, 70.0), (4, 150.0, 85.0), (5, 150.0, 95.0),
         (6, None, 85.0), (7, None, 70.0), (8, 119.0, 90.0)], "k int, sbp double, dbp double")
    out = rows(fl.flag_band(d, "sbp", "dbp", "f"), "f")
    assert out == {1: 0, 2: 1, 3: None, 4: 1, 5: None, 6: 1, 7: None, 8: None}


def test_cutoffs_and_groups(spark):
    d = spark.createDataFrame([(1, 25.0, 1), (2, 25.01, 0), (3, None, 1), (4, 95.0, 0), (5, 96.0, 2)],
                              "k int, x double, sex int")
    assert rows(fl.flag_cutoff(d, "x", 25.0, "f"), "f") == {1: 0, 2: 1, 3: None, 4: 1, 5: 1}
    assert rows(fl.flag_cutoff(d, "x", 25.0, "f", strict=False), "f") == {1: 1, 2: 1, 3: None, 4: 1, 5: 1}
    g = rows(fl.flag_group_cutoff(d, "x", "sex", {1: 115.0, 0: 95.0}, "f"), "f")
    assert g == {1: 0, 2: 0, 3: None, 4: 0, 5: None}


def test_sum_and_lab_report(spark):
    d = spark.createDataFrame([(1, 300.0, 300.0, None, 0), (2, 300.0, 299.0, 11.0, 1), (3, None, 1.0, None, 1),
                               (4, 1.0, 1.0, 10.9, 1)], "k int, a double, b double, lab double, rep int")
    assert rows(fl.flag_sum_below(d, ["a", "b"], 600.0, "f"), "f") == {1: 0, 2: 1, 3: None, 4: 1}
    assert rows(fl.flag_lab_and_report(d, "lab", 11.0, "rep", "f"), "f") == {1: 0, 2: 1, 3: None, 4: 0}


def test_rule_and_binarize_missing_is_zero(spark):
    d = spark.createDataFrame([(1, 120.0), (2, 120.5), (3, None)], "k int, s double")
    assert rows(fl.rule_baseline(d, "s", 120.0, "p"), "p") == {1: 0, 2: 1, 3: 0}
    assert rows(fl.binarize(d, "s", 120.0, "p"), "p") == {1: 0, 2: 1, 3: 0}


def test_means_propagate_missing_and_drop_inputs(spark):
    d = spark.createDataFrame([(1, 1.0, 3.0, 5.0), (2, None, 3.0, 5.0)], "k int, a double, b double, c double")
    out = ms.mean_of(d, ["a", "b", "c"], "m")
    assert out.columns == ["k", "m"]
    assert rows(out, "m") == {1: 3.0, 2: None}
    pairs = ms.mean_pairs(d, {"ab": ("a", "b")})
    assert pairs.columns == ["k", "c", "ab"]
    with pytest.raises(KeyError):
        ms.mean_of(d, ["a", "zz"], "m")


def test_weighted_both_forms(spark):
    d = spark.createDataFrame([(1, 3.0, 6.0, 9.0)], "k int, a double, b double, c double")
    w1 = ms.weighted_sum(d, dict(zip("abc", ms.AS_CODED)), "w").first()["w"]
    w2 = ms.weighted_sum(d, dict(zip("abc", ms.MEAN3)), "w").first()["w"]
    assert w1 == pytest.approx(3 + 6 + 3)
    assert w2 == pytest.approx(6.0)


def test_drop_columns_strict_and_lenient(spark):
    d = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert ms.drop_columns(d, ["b", "zz", "b"], strict=False).columns == ["a", "c"]
    with pytest.raises(KeyError):
        ms.drop_columns(d, ["zz"])


def test_reference_spec_is_complete():
    outs = [o for o, _, _ in ms.REFERENCE_MEASURES]
    assert len(outs) == 47 and len(set(outs)) == 47
    assert len(ms.REFERENCE_REMOVED) == 41 and len(set(ms.REFERENCE_REMOVED)) == 40
    assert len(fl.REFERENCE_FLAGS) == 7


def test_derive_measures_one_projection(spark):
    cols = sorted({c for _, kind, inp in ms.REFERENCE_MEASURES for c in (inp if kind != "weighted" else inp.keys())})
    d = spark.createDataFrame([tuple(float(i) for i in range(len(cols)))], ", ".join(f"{c} double" for c in cols))
    out = ms.derive_measures(d)
    assert len(out.columns) == 47
    assert "map" in out.columns and "clinic_map" not in out.columns
