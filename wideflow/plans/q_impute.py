"""Registered queries: fills (IMP-2..6), variants (SRC-2, SRC-3, SNK-2),
iterative imputation (IMP-1, IMP-1b), scaling (SCL-1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wideflow.operators import impute as im
from wideflow.operators import split as sp
from wideflow.operators.scale import MinMaxModel
from wideflow.plans.common import alloc_sql, finish, finish_sql, md5_sql, obs, ratios_sql, with_obs
from wideflow.session import ensure_checkpoint_dir
from wideflow.sources import io

Q: dict = {}
SQL: dict = {}


def _q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


FILL_COLS = ["smoke", "l_q", "sbp", "r_p"]


def _mode_sql(c):
    return (f"(SELECT CAST({c} AS DOUBLE) FROM obs WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY COUNT(*) DESC, {c} LIMIT 1)")


def _fill_sql(strategy, cols):
    parts = []
    for c in cols:
        if strategy == "mode":
            v = _mode_sql(c)
        elif strategy == "median":
            v = f"(SELECT median(CAST({c} AS DOUBLE)) FROM obs)"
        else:
            v = f"(SELECT AVG(CAST({c} AS DOUBLE)) FROM obs)"
        parts.append(f"COALESCE(CAST({c} AS DOUBLE), {v}) AS {c}")
    return ", ".join(parts)


@_q("fill_mode", finish_sql(with_obs(f"SELECT id, {_fill_sql('mode', FILL_COLS)} FROM obs"), FILL_COLS))
def q_fill_mode(spark, sf):
    """IMP-3: mode fill; ties -> smallest value."""
    return finish(im.fill(obs(spark, sf).select("id", *FILL_COLS), FILL_COLS, "mode"))


@_q("fill_mode_first", finish_sql(with_obs(
    f"SELECT id, " + ", ".join(
        f"COALESCE(CAST({c} AS DOUBLE), (SELECT CAST({c} AS DOUBLE) FROM obs WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY COUNT(*) DESC, MIN(id) LIMIT 1)) AS {c}" for c in FILL_COLS) + " FROM obs"), FILL_COLS))
def q_fill_mode_first(spark, sf):
    """IMP-3 with the reference's first-seen tie rule (lowest id first)."""
    return finish(im.fill(obs(spark, sf).select("id", *FILL_COLS), FILL_COLS, "mode", tie="first", id_col="id"))


@_q("fill_median", finish_sql(with_obs(f"SELECT id, {_fill_sql('median', FILL_COLS)} FROM obs"), FILL_COLS))
def q_fill_median(spark, sf):
    """IMP-4: exact median fill."""
    return finish(im.fill(obs(spark, sf).select("id", *FILL_COLS), FILL_COLS, "median"))


MEAN_ALL = ["n_lines", "l_q", "r_q", "l_p", "r_p", "l_d", "r_d", "sbp", "dbp", "bmi", "smoke", "lab"]


@_q("fill_mean_all", finish_sql(with_obs(f"SELECT id, {_fill_sql('mean', MEAN_ALL)} FROM obs"), MEAN_ALL))
def q_fill_mean_all(spark, sf):
    """IMP-5: mean fill of every numeric measure."""
    return finish(im.fill(obs(spark, sf).select("id", *MEAN_ALL), MEAN_ALL, "mean"))


RESIDUAL = ["l_q", "r_p", "sbp", "dbp"]


@_q("fill_mean", finish_sql(with_obs(f"SELECT id, bmi, {_fill_sql('mean', RESIDUAL)} FROM obs"), ["bmi"] + RESIDUAL))
def q_fill_mean(spark, sf):
    """IMP-2: residual mean fill of the columns that still have gaps."""
    return finish(im.fill(obs(spark, sf).select("id", "bmi", *RESIDUAL), RESIDUAL, "mean"))


def _variants_sql():
    sels = []
    for v in ("none", "mode", "median", "mean"):
        if v == "none":
            cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FILL_COLS)
        else:
            cols = _fill_sql(v, FILL_COLS)
        sels.append(f"SELECT id, {cols}, '{v}' AS variant FROM obs")
    return "\nUNION ALL\n".join(sels)


@_q("fill_variants", finish_sql(with_obs(_variants_sql()), FILL_COLS))
def q_fill_variants(spark, sf):
    """IMP-6: none / mode / median / mean variants from one profile pass."""
    return finish(im.fill_variants(obs(spark, sf).select("id", *FILL_COLS), FILL_COLS))


def _write_variants(spark, sf) -> str:
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/wideflow-variants/{uuid.uuid4().hex}"
    io.write_table(im.fill_variants(obs(spark, sf).select("id", *FILL_COLS), FILL_COLS), path,
                   partition_by=["variant"])
    return path


@_q("scan_variant", finish_sql(with_obs(f"SELECT id, {_fill_sql('mode', FILL_COLS)} FROM obs"), FILL_COLS))
def q_scan_variant(spark, sf):
    """SNK-2 then SRC-2: write the variants partitioned, read back ``mode``."""
    return finish(io.read_variant(spark, _write_variants(spark, sf), "mode"))


@_q("scan_all_variants", with_obs(
    "SELECT v AS variant, COUNT(*) AS n_rows FROM obs, (VALUES ('none'), ('mode'), ('median'), ('mean')) t(v) "
    "GROUP BY v"))
def q_scan_all_variants(spark, sf):
    """SRC-3: every variant of the written dataset, rows per variant."""
    d = io.read_variants(spark, _write_variants(spark, sf))
    return d.groupBy("variant").agg(F.count(F.lit(1)).alias("n_rows"))


IMPUTE_COLS = ["l_q", "r_p", "sbp", "dbp", "lab"]


@_q("impute_iterative_linear")
def q_impute_iterative_linear(spark, sf):
    """IMP-1b: round-robin linear imputation (rows-only check; closed-form test in tests/)."""
    d = obs(spark, sf).select("id", *IMPUTE_COLS)
    return im.IterativeImputer(IMPUTE_COLS, im.linear_estimator(), max_iter=10, seed=42).fit_transform(d)


@_q("impute_iterative")
def q_impute_iterative(spark, sf):
    """IMP-1: round-robin boosted-tree imputation at the reference's settings (100 trees
    of depth 3, up to 10 rounds)."""
    d = obs(spark, sf).select("id", *IMPUTE_COLS)
    return im.IterativeImputer(IMPUTE_COLS, im.gbt_estimator(), max_iter=10, seed=42).fit_transform(d)


SCALE_COLS = ["sbp", "dbp", "bmi", "lab", "const1"]


def _scale_sql():
    split_body = (
        "sp AS (SELECT r.id, CASE WHEN r.rk <= a.n_train THEN 'train' ELSE 'test' END AS split FROM "
        "(SELECT id, y_signal, ROW_NUMBER() OVER (PARTITION BY y_signal ORDER BY " + md5_sql("11", "id")
        + ", id) AS rk FROM base) r JOIN alloc a ON r.y_signal = a.y)")
    mm = ", ".join(f"MIN(CAST(o.{c} AS DOUBLE)) AS n_{c}, MAX(CAST(o.{c} AS DOUBLE)) AS x_{c}" for c in SCALE_COLS)
    exprs = ", ".join(
        f"CAST(o.{c} AS DOUBLE) * (CASE WHEN x_{c} - n_{c} <> 0 THEN 1.0e0 / (x_{c} - n_{c}) ELSE 1.0e0 END)"
        f" + (-n_{c} * (CASE WHEN x_{c} - n_{c} <> 0 THEN 1.0e0 / (x_{c} - n_{c}) ELSE 1.0e0 END)) AS {c}"
        for c in SCALE_COLS)
    body = f"""SELECT o.id, s.split, {exprs}
      FROM obs o JOIN sp s ON o.id = s.id, (SELECT {mm} FROM obs o JOIN sp s ON o.id = s.id WHERE s.split = 'train') m"""
    return with_obs(body, "base AS (SELECT id, y_signal FROM obs WHERE y_signal IS NOT NULL)", ratios_sql([0.2]),
                    *alloc_sql("base", "y_signal"), split_body)


@_q("minmax_scale", finish_sql(_scale_sql(), SCALE_COLS))
def q_minmax_scale(spark, sf):
    """SCL-1: fit min/max on the train split, scale train and test."""
    d = sp.stratified_split(obs(spark, sf).select("id", "y_signal", *SCALE_COLS), "id", "y_signal", 0.2, 11)
    model = MinMaxModel.fit(d.where(F.col("split") == "train"), SCALE_COLS)
    return finish(model.transform(d).select("id", "split", *SCALE_COLS))
