"""Registered queries: explanation (XPL-1..5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wideflow.operators import explain as xp
from wideflow.operators import models as md
from wideflow.plans.common import finish, finish_sql, obs, with_obs
from wideflow.plans.q_models import FEATS, LABEL, prepared

Q: dict = {}
SQL: dict = {}


def _q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# A fixed linear score: its Shapley values are known in closed form,
# phi_f = w_f * (x_f - mean of the background's x_f), so it has an exact oracle.
XFEATS = ["n_lines", "sbp", "dbp", "bmi", "lab"]
WEIGHTS = {"n_lines": 0.5, "sbp": 0.01, "dbp": 0.02, "bmi": -0.03, "lab": 0.0001}
N_BG, N_PERM = 100, 2


def _complete(spark, sf):
    return obs(spark, sf).select("id", *XFEATS).dropna(subset=XFEATS)


def _linear_phi(spark, sf):
    d = _complete(spark, sf)
    bg = xp.background(d, "id", XFEATS, N_BG, seed=0)
    return xp.shapley_values(xp.linear_predictor(WEIGHTS), d, "id", XFEATS, bg, N_PERM, seed=0)


_BG_SQL = [
    "comp AS (SELECT id, " + ", ".join(XFEATS) + " FROM obs WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in XFEATS) + ")",
    f"bg AS (SELECT * FROM comp ORDER BY md5('bg0:' || CAST(id AS VARCHAR)), id LIMIT {N_BG})",
    "bgm AS (SELECT " + ", ".join(f"AVG(CAST({f} AS DOUBLE)) AS m_{f}" for f in XFEATS) + " FROM bg)",
    "phi AS (" + " UNION ALL ".join(
        f"SELECT id, '{f}' AS feature, {WEIGHTS[f]!r}e0 * (CAST({f} AS DOUBLE) - m_{f}) AS phi, "
        f"CAST({f} AS DOUBLE) AS value FROM comp, bgm" for f in XFEATS).replace("e0e0", "e0") + ")",
]


@_q("shapley_linear", finish_sql(with_obs("SELECT id, feature, phi, value FROM phi", *_BG_SQL), ["phi", "value"]))
def q_shapley_linear(spark, sf):
    """XPL-1 on a linear score (exact oracle: phi = w (x - background mean))."""
    return finish(_linear_phi(spark, sf))


@_q("mean_abs_importance", finish_sql(with_obs(
    "SELECT feature, AVG(ABS(phi)) AS importance FROM phi GROUP BY feature", *_BG_SQL), ["importance"]))
def q_mean_abs_importance(spark, sf):
    """XPL-2: mean |phi| per feature."""
    return finish(xp.mean_abs_importance(_linear_phi(spark, sf)))


@_q("rank_importance", finish_sql(with_obs(
    """SELECT feature, importance, CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
       FROM (SELECT feature, ROUND(AVG(ABS(phi)), 6) AS importance FROM phi GROUP BY feature) t""", *_BG_SQL),
    ["importance"]))
def q_rank_importance(spark, sf):
    """XPL-3: importance ranking (descending)."""
    imp = finish(xp.mean_abs_importance(_linear_phi(spark, sf)))
    return xp.rank_importance(imp)


@_q("beeswarm_points", finish_sql(with_obs(
    """SELECT feature, phi, value,
         (value - MIN(value) OVER (PARTITION BY feature))
           / NULLIF(MAX(value) OVER (PARTITION BY feature) - MIN(value) OVER (PARTITION BY feature), 0) AS value_scaled
       FROM phi""", *_BG_SQL), ["phi", "value", "value_scaled"]))
def q_beeswarm_points(spark, sf):
    """XPL-5: (feature, phi, value, value scaled to [0, 1] per feature) behind the plot."""
    # The ranges come from the input columns: phi is computed once.
    span = _complete(spark, sf).agg(*[x for f in XFEATS for x in (
        F.min(f).cast("double").alias(f"lo_{f}"), F.max(f).cast("double").alias(f"hi_{f}"))]).first()

    def at(end):
        return F.element_at(F.create_map(*[F.lit(x) for f in XFEATS for x in (f, span[f"{end}_{f}"])]), F.col("feature"))

    return finish(_linear_phi(spark, sf).select(
        "feature", "phi", "value",
        F.try_divide(F.col("value") - at("lo"), at("hi") - at("lo")).alias("value_scaled")))


@_q("shapley_values")
def q_shapley_values(spark, sf):
    """XPL-1 on a fitted logistic regression, explaining its predicted class."""
    d = prepared(spark, sf)
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    model = md.make_model("lr", FEATS, LABEL, {"regParam": 1e-4}).fit(train)
    bg = xp.background(test, "id", FEATS, 100, seed=0)
    return xp.shapley_values(xp.model_predictor(model, "prediction"), test, "id", FEATS, bg, 2, seed=0)


@_q("partial_dependence_boosted")
def q_partial_dependence_boosted(spark, sf):
    """XPL-4 for every feature of a fitted boosted model, as the reference draws it:
    mean P(class 1) over each feature's grid, all in one pass over the test rows."""
    from wideflow.operators import boost, oof
    d = prepared(spark, sf)
    test = d.where("split = 'test'")
    grids = {i: xp.pdp_grid(test, f) for i, f in enumerate(FEATS)}
    model = boost.Boosting(LABEL, rounds=100, rate=0.1, depth=3).fit(
        oof.assembled(d.where("split = 'train'"), FEATS, ["id", LABEL]))
    out = boost.partial_dependence(model, oof.assembled(test, FEATS, ["id"]), grids)
    names = F.array(*[F.lit(f) for f in FEATS])
    return out.select(F.get(names, "position").alias("feature"), "grid_value", "average")


@_q("partial_dependence")
def q_partial_dependence(spark, sf):
    """XPL-4 on a fitted logistic regression: mean P(class 1) over the sbp grid."""
    d = prepared(spark, sf)
    train = d.where(F.col("split") == "train")
    model = md.make_model("lr", FEATS, LABEL, {"regParam": 1e-4}).fit(train)
    grid = xp.pdp_grid(train, "sbp")
    return xp.partial_dependence(xp.model_predictor(model, "p1"), train, "sbp", grid)


def _grid_sql(feature: str, name: str) -> list[str]:
    return [
        f"{name}_s AS (SELECT CAST({feature} AS DOUBLE) AS v FROM obs WHERE {feature} IS NOT NULL)",
        f"{name}_o AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS rn, COUNT(*) OVER () AS n FROM {name}_s)",
        f"""{name}_a AS (SELECT i, LEAST(GREATEST(n * p + (0.4e0 + p * (1.0e0 - 0.4e0 - 0.4e0)), 1), n - 1) AS a
             FROM (SELECT DISTINCT n FROM {name}_o) c, (VALUES (0, 0.05e0), (1, 0.95e0)) t(i, p))""",
        f"""{name}_q AS (SELECT i, (1 - g) * (SELECT v FROM {name}_o WHERE rn = k) + g * (SELECT v FROM {name}_o
               WHERE rn = k + 1) AS q
             FROM (SELECT i, floor(a) AS k, LEAST(GREATEST(a - floor(a), 0), 1) AS g FROM {name}_a) x)""",
        f"""{name}_g AS (
             SELECT '{feature}' AS feature, v AS grid_value FROM (SELECT DISTINCT v FROM {name}_s) d
             WHERE (SELECT COUNT(DISTINCT v) FROM {name}_s) < 100
             UNION ALL
             SELECT '{feature}', CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END
             FROM (SELECT MAX(q) FILTER (WHERE i = 0) AS lo, MAX(q) FILTER (WHERE i = 1) AS hi FROM {name}_q) b,
                  (SELECT unnest(range(0, 100)) AS i) r
             WHERE (SELECT COUNT(DISTINCT v) FROM {name}_s) >= 100)""",
    ]


GRID_FEATS = ["n_lines", "sbp"]


def _grids(spark, sf):
    d = obs(spark, sf)
    rows = [(f, float(v)) for f in GRID_FEATS for v in xp.pdp_grid(d, f)]
    return spark.createDataFrame(rows, "feature string, grid_value double"), rows


@_q("pdp_grid", finish_sql(with_obs(
    "SELECT * FROM n_lines_g UNION ALL SELECT * FROM sbp_g", *_grid_sql("n_lines", "n_lines"),
    *_grid_sql("sbp", "sbp")), ["grid_value"]))
def q_pdp_grid(spark, sf):
    """XPL-4 grid: distinct values (n_lines) or 100 points between the 5th
    and 95th percentiles (sbp)."""
    return finish(_grids(spark, sf)[0])


def _pdp_rule_sql():
    rest = {f: " + ".join(f"CAST({g} AS DOUBLE) * {WEIGHTS[g]!r}e0" for g in XFEATS if g != f) for f in GRID_FEATS}
    parts = [f"""SELECT g.feature, g.grid_value, AVG(g.grid_value * {WEIGHTS[f]!r}e0 + {rest[f]}) AS average
                 FROM {f}_g g, obs GROUP BY g.feature, g.grid_value""" for f in GRID_FEATS]
    return " UNION ALL ".join(parts).replace("e0e0", "e0")


@_q("pdp_rule_score", finish_sql(with_obs(_pdp_rule_sql(), *_grid_sql("n_lines", "n_lines"),
                                          *_grid_sql("sbp", "sbp")), ["grid_value", "average"]))
def q_pdp_rule_score(spark, sf):
    """XPL-4 on the fixed linear score over both grids."""
    d = obs(spark, sf).select("id", *XFEATS)
    _, rows = _grids(spark, sf)
    out = None
    for f in GRID_FEATS:
        pdp = xp.partial_dependence(xp.linear_predictor(WEIGHTS), d, f, [v for g, v in rows if g == f])
        out = pdp if out is None else out.unionByName(pdp)
    return finish(out)
