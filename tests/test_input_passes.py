"""How often the queries compute their input rows."""

import pytest
from pyspark.sql import functions as F

from wideflow.operators import impute as im
from wideflow.operators import selection as se
from wideflow.operators import split as sp
from wideflow.plans import q_models


def counted(spark, df):
    """``df``, and an accumulator of the rows that were computed of it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def rows(spark, n=300):
    return spark.range(n).select(
        "id", (F.col("id") % 7 % 2).cast("int").alias("y_signal"),
        (F.col("id") * 37 % 101).cast("double").alias("a"),
        F.when(F.col("id") % 5 != 0, (F.col("id") * 11 % 53).cast("double")).alias("b"))


def test_preparation_computes_its_input_once(spark, monkeypatch):
    df, seen = counted(spark, rows(spark))
    monkeypatch.setattr(q_models, "obs", lambda *_: df)
    out = q_models.prepared(spark, None, ["a", "b"]).collect()
    assert seen.value == 300
    assert len({r["id"] for r in out}) == len(out) == 300
    assert sum(r["split"] == "test" for r in out) == 60
    train = [r for r in out if r["split"] == "train"]
    assert min(r["a"] for r in train) == 0 and max(r["a"] for r in train) == pytest.approx(1)
    for label in (0, 1):
        sizes = [sum(r["fold"] == k and r["y_signal"] == label for r in train) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_preparation_ranks_its_rows_once(spark, monkeypatch):
    calls, own = [], sp.ranked_within
    monkeypatch.setattr(sp, "ranked_within", lambda *a, **k: calls.append(1) or own(*a, **k))
    monkeypatch.setattr(sp, "_beyond_cuts", lambda *a: pytest.fail("a ranking for the split alone"))
    monkeypatch.setattr(q_models, "obs", lambda *_: rows(spark))
    assert q_models.prepared(spark, None, ["a", "b"]).count() == 300
    assert len(calls) == 1


def test_one_ranking_gives_the_split_and_its_folds(spark):
    d = rows(spark, 523).withColumn("y_signal", F.when(F.col("id") % 50 != 0, F.col("id") % 3))
    got = sp.stratified_split_kfold(d, "id", "y_signal", 0.3, 4, 5)
    apart = sp.stratified_split(d, "id", "y_signal", 0.3, 5)
    apart = [sp.stratified_kfold(apart.where(F.col("split") == s), "id", "y_signal", 4, 5) for s in ("train", "test")]

    def places(df):
        return sorted((r["id"], r["y_signal"], r["split"], r["fold"]) for r in df.collect())

    assert places(got) == places(apart[0].unionByName(apart[1]))


def test_imputation_computes_its_input_once(spark):
    df, seen = counted(spark, rows(spark))
    out = im.IterativeImputer(["a", "b"], im.gbt_estimator(n_trees=2), max_iter=1).fit_transform(df)
    assert out.where(F.col("b").isNull()).count() == 0 and seen.value == 300


def test_a_shadow_trial_computes_its_rows_once(spark, monkeypatch):
    own, counts = se._permuted, []

    def permuted(*args):
        df, seen = counted(spark, own(*args))
        counts.append(seen)
        return df

    monkeypatch.setattr(se, "_permuted", permuted)
    d = rows(spark).withColumn("b", F.coalesce("b", F.lit(0.0)))
    hits = se.shadow_hits(d, "id", ["a", "b"], "y_signal", trials=3, num_trees=2).collect()
    assert [c.value for c in counts] == [300] * 3
    assert sorted((r["trial"], r["feature"]) for r in hits) == [(t, f) for t in range(3) for f in "ab"]


def test_packed_blocks_give_the_rows_back(spark):
    import numpy as np

    from wideflow.functions.cross import blocks, packed
    d = rows(spark).select(F.array("a", F.col("a") + 1).alias("x"), F.col("id").alias("key"),
                           (F.col("id") % 3).cast("int").alias("fold")).repartition(2)
    store = packed(d, "fold")
    assert {k for r in store.collect() for k in r["folds"]} == {0, 1, 2}
    got = [(int(k), *map(float, x)) for x, key, _ in blocks(
        store.select("n", "x", "key", "fold").toArrow().to_batches(),
        {"x": np.float64, "key": np.int64, "fold": np.int32}, 64) for k, x in zip(key, x, strict=True)]
    assert sorted(got) == [(i, i * 37 % 101, i * 37 % 101 + 1) for i in range(300)]


def test_a_fit_ends_where_a_step_is_lost_in_rounding():
    import numpy as np

    from wideflow.operators import svm
    fit = svm.Fit([0], None, 1.0)
    # the Newton step would lower a loss of 1e12 by about 1e-9
    fit.receive(np.array([1.0, 1e12, 1e-3, 0.0, 1e3, 0.0, 0.0, 1e3]))
    assert fit.done and list(fit.point) == [0.0, 0.0]
    other = svm.Fit([0], None, 1.0)
    other.receive(np.array([1.0, 1.0, 1e-3, 0.0, 1e3, 0.0, 0.0, 1e3]))
    assert not other.done and other.point[0] < 0


def test_partial_dependence_of_an_additive_score_makes_no_copies_of_rows(spark):
    from wideflow.operators import explain as xp

    def never(df):
        raise AssertionError("rows were multiplied")

    never.additive = xp.Additive({"a": 2.0, "b": 0.5}, 1.0)
    d = rows(spark)
    got = {r["grid_value"]: r["average"] for r in xp.partial_dependence(never, d, "a", [0.0, 3.0, 3.0]).collect()}
    b = [r["b"] for r in d.collect() if r["b"] is not None]
    assert got == {v: pytest.approx(1 + 2 * v + sum(b) / len(b) / 2) for v in (0.0, 3.0)}
    general = xp.linear_predictor({"a": 2.0, "b": 0.5}, 1.0)
    del general.additive
    want = {r["grid_value"]: r["average"] for r in xp.partial_dependence(general, d, "a", [0.0, 3.0, 3.0]).collect()}
    assert got == {v: pytest.approx(a) for v, a in want.items()}
