"""Registered queries: sources, measures (PRJ), flags (FLG), filters (FLT),
profiles (AGG), alignment (SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wideflow.operators import clean as cl
from wideflow.operators import evaluate as ev
from wideflow.operators import flags as fl
from wideflow.operators import measures as ms
from wideflow.operators import profile as pr
from wideflow.plans.cleaning import REFERENCE_NAMES
from wideflow.plans.common import METRIC_DOUBLES, finish, finish_sql, metric_sql, obs, with_obs
from wideflow.sources.fixtures import OBS_COLUMNS, OBS_DOUBLES
from wideflow.sources.io import clean_nan

Q: dict = {}
SQL: dict = {}


def _q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _excl(*cols):
    return [c for c in OBS_COLUMNS if c not in cols]


def _dbl(cols):
    return [c for c in cols if c in OBS_DOUBLES]


# ------------------------------------------------------------------ SRC-1
@_q("scan_clean_nan", finish_sql(with_obs(
    """SELECT id, CASE WHEN isnan(x) THEN NULL ELSE x END AS x, sbp FROM (
         SELECT id, CASE WHEN id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE sbp END AS x, sbp FROM obs) t"""),
    ["x", "sbp"]))
def q_scan_clean_nan(spark, sf):
    """SRC-1: a NaN made by expression must come out as NULL."""
    d = obs(spark, sf).select("id", F.when(F.col("id") % 7 == 0, F.lit(float("nan")))
                              .otherwise(F.col("sbp")).alias("x"), "sbp")
    return finish(clean_nan(d))


# ------------------------------------------------------------------ PRJ
_SIX = ["l_q", "r_q", "l_p", "r_p", "l_d", "r_d"]


@_q("mean_n_way", finish_sql(with_obs(
    "SELECT id, sbp, (l_q + r_q + l_p + r_p + l_d + r_d) / 6.0e0 AS m6 FROM obs"), ["sbp", "m6"]))
def q_mean_n_way(spark, sf):
    return finish(ms.mean_of(obs(spark, sf).select("id", *_SIX, "sbp"), _SIX, "m6"))


@_q("mean_pairs", finish_sql(with_obs(
    "SELECT id, bmi, (l_q + r_q) / 2.0e0 AS q, (l_p + r_p) / 2.0e0 AS p, (l_d + r_d) / 2.0e0 AS d FROM obs"),
    ["bmi", "q", "p", "d"]))
def q_mean_pairs(spark, sf):
    d = obs(spark, sf).select("id", *_SIX, "bmi")
    return finish(ms.mean_pairs(d, {"q": ("l_q", "r_q"), "p": ("l_p", "r_p"), "d": ("l_d", "r_d")}))


@_q("rename_measure", finish_sql(with_obs("SELECT id, lab AS balance FROM obs"), ["balance"]))
def q_rename_measure(spark, sf):
    return finish(ms.rename_measures(obs(spark, sf).select("id", "lab"), {"lab": "balance"}))


@_q("weighted_combo", finish_sql(with_obs(
    f"""SELECT id, l_q * 1.0e0 + r_q * 1.0e0 + n_lines * {ms.AS_CODED[2]!r}e0 AS w_coded,
       l_q * {ms.MEAN3[0]!r}e0 + r_q * {ms.MEAN3[1]!r}e0 + n_lines * {ms.MEAN3[2]!r}e0 AS w_mean FROM obs"""
    .replace("e0e0", "e0")), ["w_coded", "w_mean"]))
def q_weighted_combo(spark, sf):
    d = obs(spark, sf).select("id", "l_q", "r_q", "n_lines")
    w = dict(zip(["l_q", "r_q", "n_lines"], ms.AS_CODED))
    d = ms.weighted_sum(d, w, "w_coded", drop=False)
    d = ms.weighted_sum(d, dict(zip(["l_q", "r_q", "n_lines"], ms.MEAN3)), "w_mean")
    return finish(d)


@_q("drop_if_exists", finish_sql(with_obs(f"SELECT {', '.join(_excl('sparse20', 'txt'))} FROM obs"),
                                 _dbl(_excl("sparse20", "txt"))))
def q_drop_if_exists(spark, sf):
    return finish(ms.drop_columns(obs(spark, sf), ["sparse20", "txt", "not_a_column", "txt"], strict=False))


@_q("numeric_only", finish_sql(with_obs(f"SELECT {', '.join(_excl('txt'))} FROM obs"), _dbl(_excl("txt"))))
def q_numeric_only(spark, sf):
    return finish(cl.numeric_only(obs(spark, sf)))


@_q("coerce_numeric", finish_sql(with_obs("SELECT id, TRY_CAST(txt AS DOUBLE) AS txt, lab FROM obs"), ["lab"]))
def q_coerce_numeric(spark, sf):
    return finish(cl.coerce_numeric(obs(spark, sf).select("id", "txt", "lab"), ["txt"]))


@_q("select_features", finish_sql(with_obs("SELECT id, y_signal, sbp, dbp, bmi FROM obs"), ["sbp", "dbp", "bmi"]))
def q_select_features(spark, sf):
    return finish(cl.select_features(obs(spark, sf), ["sbp", "dbp", "bmi"], keep=["id", "y_signal"]))


# ------------------------------------------------------------------ FLG-1..7
@_q("flag_two_measure_band", with_obs(
    """SELECT id, CAST(CASE WHEN (sbp < 140 AND sbp > 119) OR (dbp < 90 AND dbp > 79) THEN 1
                            WHEN sbp <= 119 AND dbp <= 79 THEN 0 END AS INTEGER) AS prehypertensive FROM obs"""))
def q_flag_band(spark, sf):
    return fl.flag_band(obs(spark, sf), "sbp", "dbp", "prehypertensive").select("id", "prehypertensive")


@_q("flag_cutoff_gt", with_obs(
    "SELECT id, CAST(CASE WHEN bmi > 25 THEN 1 WHEN bmi <= 25 THEN 0 END AS INTEGER) AS obese FROM obs"))
def q_flag_cutoff_gt(spark, sf):
    return fl.flag_cutoff(obs(spark, sf), "bmi", 25.0, "obese").select("id", "obese")


@_q("flag_group_cutoff", with_obs(
    """SELECT id, CAST(CASE WHEN (l_p > 1500000 AND sex = 1) OR (l_p > 1000000 AND sex = 0) THEN 1
                            WHEN (l_p <= 1500000 AND sex = 1) OR (l_p <= 1000000 AND sex = 0) THEN 0 END
                       AS INTEGER) AS lvh FROM obs"""))
def q_flag_group_cutoff(spark, sf):
    return fl.flag_group_cutoff(obs(spark, sf), "l_p", "sex", {1: 1500000.0, 0: 1000000.0}, "lvh").select("id", "lvh")


@_q("flag_sum_cutoff", with_obs(
    """SELECT id, CAST(CASE WHEN l_q + r_q + n_lines + sbp + dbp < 200 THEN 1
                            WHEN l_q + r_q + n_lines + sbp + dbp >= 200 THEN 0 END AS INTEGER) AS sedentary
       FROM obs"""))
def q_flag_sum_cutoff(spark, sf):
    return fl.flag_sum_below(obs(spark, sf), ["l_q", "r_q", "n_lines", "sbp", "dbp"], 200.0,
                             "sedentary").select("id", "sedentary")


@_q("flag_or_and", with_obs(
    """SELECT id, CAST(CASE WHEN lab >= 5000 AND smoke = 1 THEN 1 WHEN lab < 5000 OR smoke = 0 THEN 0 END
                       AS INTEGER) AS smoker FROM obs"""))
def q_flag_or_and(spark, sf):
    return fl.flag_lab_and_report(obs(spark, sf), "lab", 5000.0, "smoke", "smoker").select("id", "smoker")


@_q("flag_or_and_second", with_obs(
    """SELECT id, CAST(CASE WHEN lab >= 49 AND status = 1 THEN 1 WHEN lab < 49 OR status = 0 THEN 0 END
                       AS INTEGER) AS excessive FROM obs"""))
def q_flag_or_and_second(spark, sf):
    return fl.flag_lab_and_report(obs(spark, sf), "lab", 49.0, "status", "excessive").select("id", "excessive")


@_q("flag_cutoff_ge", with_obs(
    "SELECT id, CAST(CASE WHEN lab >= 3500 THEN 1 WHEN lab < 3500 THEN 0 END AS INTEGER) AS dyslipidemic FROM obs"))
def q_flag_cutoff_ge(spark, sf):
    return fl.flag_cutoff(obs(spark, sf), "lab", 3500.0, "dyslipidemic", strict=False).select("id", "dyslipidemic")


# ------------------------------------------------------------------ FLT-1, 2
@_q("drop_missing_label", finish_sql(with_obs("SELECT * FROM obs WHERE y_signal IS NOT NULL"), OBS_DOUBLES))
def q_drop_missing_label(spark, sf):
    return finish(cl.drop_missing(obs(spark, sf), ["y_signal"]))


@_q("filter_ne_keep_null", finish_sql(with_obs("SELECT * FROM obs WHERE status IS DISTINCT FROM 1"), OBS_DOUBLES))
def q_filter_ne_keep_null(spark, sf):
    return finish(cl.filter_not_equal(obs(spark, sf), "status", 1))


# ------------------------------------------------------------------ AGG-1..5
def _union_per_column(expr_fmt: str, cols) -> str:
    return "\nUNION ALL\n".join(expr_fmt.format(c=c) for c in cols)


_MISSING_SQL = _union_per_column(
    "SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_missing, "
    "(COUNT(*) - COUNT({c})) * 100.0e0 / COUNT(*) AS missing_pct FROM obs", OBS_COLUMNS)
_NUNIQUE_SQL = _union_per_column("SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_unique FROM obs",
                                 OBS_COLUMNS)


@_q("missing_pct_columns", finish_sql(with_obs(_MISSING_SQL), ["missing_pct"]))
def q_missing_pct_columns(spark, sf):
    return finish(pr.missing_counts(obs(spark, sf)))


@_q("nunique_columns", with_obs(f"SELECT * FROM ({_NUNIQUE_SQL}) u"))
def q_nunique_columns(spark, sf):
    return pr.profile(obs(spark, sf)).select("column", "n_unique")


@_q("profile_columns", finish_sql(with_obs(
    'SELECT m."column", n_rows, n_missing, missing_pct, n_unique FROM m JOIN u ON m."column" = u."column"',
    f"m AS ({_MISSING_SQL})", f"u AS ({_NUNIQUE_SQL})"), ["missing_pct"]))
def q_profile_columns(spark, sf):
    return finish(pr.profile(obs(spark, sf)))


_ROWMISS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in OBS_COLUMNS if c != "id")


@_q("missing_pct_rows", finish_sql(with_obs(
    f"SELECT id, {_ROWMISS} AS n_missing, ({_ROWMISS}) * 100.0e0 / {len(OBS_COLUMNS) - 1} AS missing_pct FROM obs"),
    ["missing_pct"]))
def q_missing_pct_rows(spark, sf):
    return finish(pr.row_missing_pct(obs(spark, sf), "id", [c for c in OBS_COLUMNS if c != "id"]))


@_q("shape_report", with_obs(f"SELECT COUNT(*) AS n_rows, CAST({len(OBS_COLUMNS)} AS INTEGER) AS n_columns FROM obs"))
def q_shape_report(spark, sf):
    return pr.shape(obs(spark, sf))


@_q("assert_complete", with_obs(
    "SELECT CAST(" + " + ".join(f"(COUNT(*) - COUNT({c}))" for c in OBS_COLUMNS) + " AS BIGINT) AS total_missing FROM obs"))
def q_assert_complete(spark, sf):
    """AGG-5 reported as a count (the guard itself is ``profile.assert_complete``)."""
    return pr.total_missing(obs(spark, sf))


# ------------------------------------------------------------------ FLT-3..5
_AFTER_COLS = _excl("sparse20", "status")
_ROWMISS2 = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _AFTER_COLS)


@_q("drop_sparse_columns", finish_sql(with_obs(f"SELECT {', '.join(_AFTER_COLS)} FROM obs"), _dbl(_AFTER_COLS)))
def q_drop_sparse_columns(spark, sf):
    return finish(pr.drop_sparse_columns(obs(spark, sf), 10.0))


@_q("drop_sparse_rows", finish_sql(with_obs(
    f"SELECT {', '.join(_AFTER_COLS)} FROM obs WHERE ({_ROWMISS2}) * 100.0e0 / {len(_AFTER_COLS)} <= 10"),
    _dbl(_AFTER_COLS)))
def q_drop_sparse_rows(spark, sf):
    return finish(pr.drop_sparse_rows(pr.drop_sparse_columns(obs(spark, sf), 10.0), 10.0))


@_q("drop_constant_columns", finish_sql(with_obs(f"SELECT {', '.join(_excl('const1', 'const_null'))} FROM obs"),
                                        _dbl(_excl("const1", "const_null"))))
def q_drop_constant_columns(spark, sf):
    return finish(pr.drop_constant_columns(obs(spark, sf)))


# ------------------------------------------------------------------ PRJ-8, 10; FLT-6; SET-1..4
_CATEGORIC = ["sex", "ethnicity", "grade", "sex"]


def _roles_table(spark, sf):
    d = obs(spark, sf)
    roles = cl.feature_roles(d, _CATEGORIC, "y_signal", "id")
    rt = spark.createDataFrame(roles, "feature string, role string")
    prof = pr.missing_counts(d).select(F.col("column").alias("feature"), "missing_pct")
    return rt.join(prof, on="feature", how="inner")


_NUMERIC_FEATS = [c for c in OBS_COLUMNS if c not in ("id", "y_signal", "txt", "sex", "ethnicity", "grade")]
_ROLES_SQL = ("roles AS (SELECT * FROM (VALUES "
              + ", ".join([f"('{c}', 'categoric')" for c in ["sex", "ethnicity", "grade"]]
                          + [f"('{c}', 'numeric')" for c in _NUMERIC_FEATS]
                          + ["('y_signal', 'label')", "('id', 'id')"])
              + ") t(feature, role))")


@_q("feature_roles", finish_sql(with_obs(
    'SELECT r.feature, r.role, m.missing_pct FROM roles r JOIN m ON r.feature = m."column"',
    f"m AS ({_MISSING_SQL})", _ROLES_SQL), ["missing_pct"]))
def q_feature_roles(spark, sf):
    """PRJ-8: roles of every column, with the profile that drives later drops."""
    return finish(_roles_table(spark, sf))


# Display names for some feature codes (one code deliberately has none).
_NAMES = list(REFERENCE_NAMES.items())
_NAMES_SQL = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NAMES) + ") t(feature, label))"


@_q("display_names", finish_sql(with_obs(
    """SELECT m."column" AS feature, m.missing_pct, COALESCE(n.label, m."column") AS display_name
       FROM m LEFT JOIN names n ON m."column" = n.feature""", f"m AS ({_MISSING_SQL})", _NAMES_SQL),
    ["missing_pct"]))
def q_display_names(spark, sf):
    feats = pr.missing_counts(obs(spark, sf)).select(F.col("column").alias("feature"), "missing_pct")
    names = spark.createDataFrame(_NAMES, "feature string, label string")
    return finish(cl.display_names(feats, names))


@_q("exclude_features", finish_sql(with_obs(
    """SELECT "column" AS feature, missing_pct FROM m WHERE "column" NOT IN ('id', 'y_signal', 'y_noise')""",
    f"m AS ({_MISSING_SQL})"), ["missing_pct"]))
def q_exclude_features(spark, sf):
    feats = pr.missing_counts(obs(spark, sf)).select(F.col("column").alias("feature"), "missing_pct")
    return finish(cl.exclude_features(feats, ["id", "y_signal", "y_noise"]))


@_q("concat_columns", finish_sql(with_obs("SELECT id, sbp, dbp, bmi, lab FROM obs"), ["sbp", "dbp", "bmi", "lab"]))
def q_concat_columns(spark, sf):
    d = obs(spark, sf)
    return finish(cl.align_on_id(d.select("id", "sbp", "dbp"), d.select("id", "bmi", "lab", "sbp"), "id"))


@_q("feature_set_ops", with_obs(
    """SELECT "column" AS feature, 'overlap' AS op FROM m WHERE n_missing > 0 AND "column" IN ({dbl})
       UNION ALL
       SELECT "column", 'a_minus_b' FROM m WHERE n_missing > 0 AND "column" NOT IN ({dbl})"""
    .format(dbl=", ".join(f"'{c}'" for c in OBS_DOUBLES)), f"m AS ({_MISSING_SQL})"))
def q_feature_set_ops(spark, sf):
    """SET-2: incomplete columns (from the data) against the double-typed ones."""
    d = obs(spark, sf)
    a = pr.missing_counts(d).where(F.col("n_missing") > 0).select(F.col("column").alias("feature"))
    b = spark.createDataFrame([(c,) for c in OBS_DOUBLES], "feature string")
    return (cl.feature_overlap(a, b).withColumn("op", F.lit("overlap"))
            .unionByName(cl.feature_minus(a, b).withColumn("op", F.lit("a_minus_b"))))


@_q("ragged_align", with_obs(
    """SELECT pos, MAX(feature) FILTER (WHERE method = 'complete') AS complete,
              MAX(feature) FILTER (WHERE method = 'incomplete') AS incomplete
       FROM (SELECT CASE WHEN n_missing > 0 THEN 'incomplete' ELSE 'complete' END AS method,
                    CAST(ROW_NUMBER() OVER (PARTITION BY n_missing > 0 ORDER BY n_missing DESC, "column")
                         AS INTEGER) AS pos,
                    "column" AS feature FROM m) t GROUP BY pos""", f"m AS ({_MISSING_SQL})"))
def q_ragged_align(spark, sf):
    """SET-3: two feature lists of unequal length (from the data) by position."""
    from pyspark.sql import Window
    m = pr.missing_counts(obs(spark, sf))
    method = F.when(F.col("n_missing") > 0, "incomplete").otherwise("complete")
    w = Window.partitionBy(method).orderBy(F.col("n_missing").desc(), F.col("column"))
    lists = m.select(method.alias("method"), F.row_number().over(w).cast("int").alias("pos"),
                     F.col("column").alias("feature"))
    return cl.ragged_align(lists, methods=["complete", "incomplete"])


_RC = """rc AS (SELECT model, score, CAST(COUNT(*) FILTER (WHERE y_signal = 1) AS BIGINT) AS pos,
    CAST(COUNT(*) FILTER (WHERE y_signal <> 1) AS BIGINT) AS neg FROM (
      SELECT 'rule' AS model, CAST(CASE WHEN sbp > 120 THEN 1 ELSE 0 END AS DOUBLE) AS score, y_signal FROM obs
      UNION ALL SELECT 'noise', CAST(y_noise AS DOUBLE), y_signal FROM obs) u
    WHERE y_signal IS NOT NULL AND score IS NOT NULL GROUP BY model, score)"""
_c, _f = metric_sql("rc", ["model"], "0.5e0")


@_q("append_results", finish_sql(with_obs(_f, _RC, *_c), METRIC_DOUBLES))
def q_append_results(spark, sf):
    """SET-4: two metric records stacked by column name."""
    d = fl.rule_baseline(obs(spark, sf), "sbp", 120.0, "rule_pred")
    a = ev.binary_performance(d, "y_signal", "rule_pred", 0.5).withColumn("model", F.lit("rule"))
    b = ev.binary_performance(d, "y_signal", "y_noise", 0.5).withColumn("model", F.lit("noise"))
    return finish(cl.append_results(a, b))
