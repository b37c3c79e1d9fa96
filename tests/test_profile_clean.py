"""AGG, FLT, PRJ-7..10, SET: profiles and drops on hand tables."""

import pytest
from pyspark.sql import functions as F

from wideflow.operators import clean as cl
from wideflow.operators import profile as pr


@pytest.fixture
def table(spark):
    data = []
    for i in range(10):
        data.append((i, float(i), None if i == 0 else 1.0, None if i < 2 else float(i % 3), 7, None,
                     None if i == 3 else 5, "t"))
    return spark.createDataFrame(data, "id int, x double, ten double, twenty double, const int, "
                                       "allnull double, constnull int, s string")


def test_missing_counts_and_strict_drop(table):
    m = {r["column"]: r["missing_pct"] for r in pr.missing_counts(table).collect()}
    assert m["ten"] == 10.0 and m["twenty"] == 20.0 and m["allnull"] == 100.0
    kept = pr.drop_sparse_columns(table, 10.0).columns
    assert "ten" in kept and "twenty" not in kept and "allnull" not in kept


def test_row_drop_uses_remaining_columns(table):
    d = pr.drop_sparse_columns(table, 10.0)  # 6 columns left
    out = pr.drop_sparse_rows(d, 10.0)
    # rows 0 and 3 have one missing of 6 (16.7 %) -> dropped
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 4, 5, 6, 7, 8, 9]


def test_constant_columns_all_missing_stays(table):
    const = pr.constant_columns(table)
    assert set(const) == {"const", "constnull", "s", "ten"}
    assert "allnull" in pr.drop_constant_columns(table).columns


def test_distinct_counts_skip_missing(table):
    p = {r["column"]: r["n_unique"] for r in pr.profile(table).collect()}
    assert p["twenty"] == 3 and p["allnull"] == 0 and p["constnull"] == 1 and p["x"] == 10


def test_assert_complete_raises(spark, table):
    with pytest.raises(Exception):
        pr.assert_complete(table).collect()
    ok = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert pr.assert_complete(ok).count() == 1
    assert pr.total_missing(table).first()[0] == 1 + 2 + 10 + 1


def test_filter_not_equal_keeps_missing(spark):
    d = spark.createDataFrame([(1,), (2,), (None,)], "s int")
    assert sorted([r[0] for r in cl.filter_not_equal(d, "s", 1).collect()], key=str) == [2, None]


def test_roles_and_numeric(spark, table):
    roles = dict(cl.feature_roles(table, ["const", "const", "missing_col"], "x", "id"))
    assert roles["const"] == "categoric" and roles["ten"] == "numeric" and roles["x"] == "label"
    assert "s" not in roles
    assert "s" not in cl.numeric_only(table).columns
    co = cl.coerce_numeric(spark.createDataFrame([("1.5",), ("abc",)], "v string"), ["v"])
    assert [r[0] for r in co.collect()] == [1.5, None]


def test_display_names_fallback(spark):
    f = spark.createDataFrame([("a",), ("b",)], "feature string")
    n = spark.createDataFrame([("a", "Alpha")], "feature string, label string")
    assert {r[0]: r[1] for r in cl.display_names(f, n).collect()} == {"a": "Alpha", "b": "b"}


def test_align_and_ragged(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, x double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "id int, y double")
    out = {r["id"]: (r["x"], r["y"]) for r in cl.align_on_id(a, b, "id").collect()}
    assert out == {1: (1.0, None), 2: (2.0, 5.0), 3: (None, 6.0)}
    lists = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b"), ("r", 1, "c")], "method string, pos int, feature string")
    rag = {r["pos"]: (r["m"], r["r"]) for r in cl.ragged_align(lists, methods=["m", "r"]).collect()}
    assert rag == {1: ("a", "c"), 2: ("b", None)}


def test_approx_profile_close(table):
    p = {r["column"]: r["n_unique"] for r in pr.profile(table, exact=False).collect()}
    assert p["x"] == 10 and p["twenty"] == 3 and p["allnull"] == 0


def test_zero_signs_are_one_value(spark):
    from wideflow.operators import profile as pr
    d = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (None,)], "x double")
    assert pr.distinct_counts(d).first()["n_unique"] == 2
    assert pr.profile(d).first()["n_unique"] == 2


def test_range_buckets_follow_the_data(spark):
    from wideflow.functions.ranking import _B, ordered_scan, range_buckets
    spark.conf.set("spark.sql.shuffle.partitions", "128")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.range(100_000).selectExpr("CAST(id + 1700000000 AS DOUBLE) AS v", "1L AS n")
        assert range_buckets(d, ["v"]).select(_B).distinct().count() >= 100
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    s = ordered_scan(d.withColumn("g", d.v * 0), ["g"], "v", ["n"], descending=False)
    assert s.where("cum_n <> v - 1699999999 OR prev_n <> cum_n - 1").count() == 0
