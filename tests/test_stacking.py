import numpy as np
import pytest

from wideflow.operators import models as md
from wideflow.operators import oof
from wideflow.operators.boost import Boosting
from wideflow.operators.network import Network
from wideflow.plans import q_models


def test_stack_of_four_kinds_keeps_repeated_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.3, 150) > 0).astype(float)
    rows = [(i // 2, *map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    d = spark.createDataFrame(rows, "id long, a double, b double, y double, fold int")
    bases = {"lr": md.make_estimator("lr", "y", {"regParam": 1e-2}),
             "rf": md.make_estimator("rf", "y", {"numTrees": 3}),
             "mlp": Network("y", hidden=4, batch=60, rate=0.1, epochs=8), "gbt": Boosting("y", rounds=4, depth=2)}
    out = md.StackingClassifier(bases, "y", features=["a", "b"], c=1.0).fit(d).transform(d)
    assert out.columns == [*d.columns, "prediction", "p1"]
    got = out.collect()
    assert len(got) == 150 and np.mean([(r["p1"] > 0.5) == (r["y"] == 1) for r in got]) > 0.8


def test_bases_of_other_features_are_refused():
    with pytest.raises(ValueError, match="one list"):
        md.StackingClassifier({"a": Boosting("y")}, "y")


def test_query_stacks_the_four_models_of_the_reference(spark, sf, monkeypatch):
    kinds = {}

    class Stop(Exception):
        pass

    def jobs(data, jobs, fold=None, parallelism=4):
        for est, k in jobs:
            kinds.setdefault(type(est).__name__, []).append(k)
        raise Stop

    monkeypatch.setattr(oof, "fit_jobs", jobs)
    with pytest.raises(Stop):
        q_models.q_model_stacking(spark, sf)
    assert kinds == {k: [0, 1, 2, 3, 4, None] for k in (
        "LogisticRegression", "RandomForestClassifier", "Network", "Boosting")}
