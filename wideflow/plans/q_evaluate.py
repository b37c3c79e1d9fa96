"""Registered queries: splits (SPL), evaluation (EVL), thresholds (THR), sweep (SWP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wideflow.operators import evaluate as ev
from wideflow.operators import flags as fl
from wideflow.operators import split as sp
from wideflow.plans.common import (
    METRIC_DOUBLES, SWEEP_RATIOS, SWEEP_SEEDS, alloc_sql, finish, finish_sql, md5_sql,
    metric_sql, obs, ratios_sql, seeds_sql, with_obs,
)

Q: dict = {}
SQL: dict = {}

LABEL = "y_signal"


def _rule(spark, sf):
    return fl.rule_baseline(obs(spark, sf), "sbp", 120.0, "rule_pred")


# ------------------------------------------------------------------ flags used as scores
def q_rule_baseline(spark, sf):
    return _rule(spark, sf).select("id", "sbp", "rule_pred")


Q["rule_baseline"] = q_rule_baseline
SQL["rule_baseline"] = finish_sql(with_obs(
    "SELECT id, sbp, CAST(CASE WHEN sbp > 120 THEN 1 ELSE 0 END AS INTEGER) AS rule_pred FROM obs"), ["sbp"])


def q_binarize_score(spark, sf):
    d = obs(spark, sf).withColumn("score", F.col("n_lines") / F.lit(8.0))
    return finish(fl.binarize(d, "score", 0.5, "pred").select("id", "score", "pred"))


Q["binarize_score"] = q_binarize_score
SQL["binarize_score"] = finish_sql(with_obs(
    "SELECT id, n_lines / 8.0e0 AS score, CAST(CASE WHEN n_lines / 8.0e0 > 0.5e0 THEN 1 ELSE 0 END AS INTEGER)"
    " AS pred FROM obs"), ["score"])

# ------------------------------------------------------------------ EVL-1..3, 9
_CM_SQL = """SELECT grade,
  CAST(COUNT(*) FILTER (WHERE y_signal <> 1 AND NOT sbp > 120.0e0) AS BIGINT) AS tn,
  CAST(COUNT(*) FILTER (WHERE y_signal <> 1 AND sbp > 120.0e0) AS BIGINT) AS fp,
  CAST(COUNT(*) FILTER (WHERE y_signal = 1 AND NOT sbp > 120.0e0) AS BIGINT) AS fn,
  CAST(COUNT(*) FILTER (WHERE y_signal = 1 AND sbp > 120.0e0) AS BIGINT) AS tp
FROM obs WHERE y_signal IS NOT NULL AND sbp IS NOT NULL GROUP BY grade"""


def q_confusion_matrix(spark, sf):
    return ev.confusion(obs(spark, sf), LABEL, "sbp", 120.0, by=["grade"])


Q["confusion_matrix"] = q_confusion_matrix
SQL["confusion_matrix"] = with_obs(_CM_SQL)

_RATES = """CAST(tp + tn AS DOUBLE) / NULLIF({den}, 0) AS accuracy,
  CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision,
  CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall,
  2.0e0 * (CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)) * (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0))
    / NULLIF(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) + CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS f1_score"""


def q_binary_rates(spark, sf):
    return finish(ev.rates(ev.confusion(obs(spark, sf), LABEL, "sbp", 120.0, by=["grade"])))


Q["binary_rates"] = q_binary_rates
SQL["binary_rates"] = finish_sql(with_obs(
    "SELECT *, " + _RATES.format(den="(tp + tn + fp + fn)") + " FROM cm", f"cm AS ({_CM_SQL})"),
    ["accuracy", "precision", "recall", "f1_score"])


def q_accuracy_as_coded(spark, sf):
    return finish(ev.rates(ev.confusion(obs(spark, sf), LABEL, "sbp", 120.0, by=["grade"]), as_coded=True))


Q["accuracy_as_coded"] = q_accuracy_as_coded
SQL["accuracy_as_coded"] = finish_sql(with_obs(
    "SELECT *, " + _RATES.format(den="(tp + fp + tn + fp)") + " FROM cm", f"cm AS ({_CM_SQL})"),
    ["accuracy", "precision", "recall", "f1_score"])


def q_decision_point(spark, sf):
    return finish(ev.decision_point(ev.confusion(obs(spark, sf), LABEL, "sbp", 120.0, by=["grade"])))


Q["decision_point"] = q_decision_point
SQL["decision_point"] = finish_sql(with_obs(
    """SELECT *, CAST(fp AS DOUBLE) / NULLIF(fp + tn, 0) AS fpr, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS tpr,
       CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall, CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision
    FROM cm""", f"cm AS ({_CM_SQL})"), ["fpr", "tpr", "recall", "precision"])

# ------------------------------------------------------------------ EVL-4..7 on n_lines (many ties)
_COUNTS_NLINES = """cnt AS (SELECT grade, CAST(n_lines AS DOUBLE) AS score,
    CAST(COUNT(*) FILTER (WHERE y_signal = 1) AS BIGINT) AS pos,
    CAST(COUNT(*) FILTER (WHERE y_signal <> 1) AS BIGINT) AS neg
  FROM obs WHERE y_signal IS NOT NULL AND n_lines IS NOT NULL GROUP BY grade, CAST(n_lines AS DOUBLE))"""
_SCAN2 = """scan AS (SELECT grade, score, pos, neg,
    SUM(pos) OVER w AS cum_pos, SUM(neg) OVER w AS cum_neg
  FROM cnt WINDOW w AS (PARTITION BY grade ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
scan2 AS (SELECT *, cum_pos - pos AS prev_pos, cum_neg - neg AS prev_neg,
    LEAD(cum_pos) OVER (PARTITION BY grade ORDER BY score DESC) AS next_pos,
    LEAD(cum_neg) OVER (PARTITION BY grade ORDER BY score DESC) AS next_neg,
    SUM(pos) OVER (PARTITION BY grade) AS p, SUM(neg) OVER (PARTITION BY grade) AS n
  FROM scan)"""


def q_roc_points(spark, sf):
    return finish(ev.roc_points(obs(spark, sf), LABEL, "n_lines", by=["grade"]))


Q["roc_points"] = q_roc_points
SQL["roc_points"] = finish_sql(with_obs(
    """SELECT grade, score AS threshold, CAST(cum_neg AS DOUBLE) / NULLIF(n, 0) AS fpr,
         CAST(cum_pos AS DOUBLE) / NULLIF(p, 0) AS tpr
       FROM scan2
       WHERE prev_pos + prev_neg = 0 OR next_pos IS NULL
          OR next_pos - 2 * cum_pos + prev_pos <> 0 OR next_neg - 2 * cum_neg + prev_neg <> 0
       UNION ALL
       SELECT grade, CAST(NULL AS DOUBLE), CASE WHEN SUM(neg) > 0 THEN 0.0e0 END,
              CASE WHEN SUM(pos) > 0 THEN 0.0e0 END FROM cnt GROUP BY grade""",
    _COUNTS_NLINES, _SCAN2), ["threshold", "fpr", "tpr"])


def q_pr_points(spark, sf):
    return finish(ev.pr_points(obs(spark, sf), LABEL, "n_lines", by=["grade"]))


Q["pr_points"] = q_pr_points
SQL["pr_points"] = finish_sql(with_obs(
    """SELECT grade, score AS threshold, CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg) AS precision,
         CAST(cum_pos AS DOUBLE) / NULLIF(p, 0) AS recall
       FROM scan2
       UNION ALL
       SELECT grade, CAST(NULL AS DOUBLE), 1.0e0, 0.0e0 FROM cnt GROUP BY grade""",
    _COUNTS_NLINES, _SCAN2), ["threshold", "precision", "recall"])

_AREAS = """SELECT grade,
    CAST(SUM(neg * (2 * cum_pos - pos)) AS DOUBLE) / NULLIF(2 * SUM(pos) * SUM(neg), 0) AS auc,
    SUM(pos * (cum_pos / (cum_pos + cum_neg)
        + CASE WHEN prev_pos + prev_neg = 0 THEN 1.0e0 ELSE prev_pos / (prev_pos + prev_neg) END))
      / NULLIF(2 * SUM(pos), 0) AS pr_auc
  FROM scan2 GROUP BY grade"""


def q_roc_auc(spark, sf):
    return finish(ev.roc_auc(obs(spark, sf), LABEL, "n_lines", by=["grade"]))


Q["roc_auc"] = q_roc_auc
SQL["roc_auc"] = finish_sql(with_obs(
    "SELECT grade, auc FROM areas", _COUNTS_NLINES, _SCAN2, f"areas AS ({_AREAS})"), ["auc"])


def q_pr_auc(spark, sf):
    return finish(ev.pr_auc(obs(spark, sf), LABEL, "n_lines", by=["grade"]))


Q["pr_auc"] = q_pr_auc
SQL["pr_auc"] = finish_sql(with_obs(
    "SELECT grade, pr_auc FROM areas", _COUNTS_NLINES, _SCAN2, f"areas AS ({_AREAS})"), ["pr_auc"])


def q_prevalence(spark, sf):
    return finish(ev.prevalence(obs(spark, sf), LABEL, by=["grade"]))


Q["prevalence"] = q_prevalence
SQL["prevalence"] = finish_sql(with_obs(
    "SELECT grade, AVG(CAST(y_signal AS DOUBLE)) AS prevalence FROM obs WHERE y_signal IS NOT NULL GROUP BY grade"),
    ["prevalence"])


# ------------------------------------------------------------------ EVL-8
def q_score_histogram(spark, sf):
    return finish(ev.score_histogram(obs(spark, sf), LABEL, "sbp", 25))


Q["score_histogram"] = q_score_histogram
SQL["score_histogram"] = finish_sql(with_obs(
    """SELECT g.label, g.bin, g.lo + g.bin * ((g.hi - g.lo) / 25) AS bin_lo,
         g.lo + (g.bin + 1) * ((g.hi - g.lo) / 25) AS bin_hi,
         CAST(COALESCE(c.n, 0) AS BIGINT) AS n,
         COALESCE(c.n, 0) / (g.cnt * ((g.hi - g.lo) / 25)) AS density
       FROM (SELECT s.*, unnest(range(0, 25)) AS bin FROM st s) g
       LEFT JOIN (SELECT d.label, LEAST(GREATEST(CAST(floor((d.x - s.lo) / ((s.hi - s.lo) / 25)) AS INTEGER), 0), 24)
                         AS bin, COUNT(*) AS n
                  FROM d JOIN st s ON d.label = s.label GROUP BY ALL) c
         ON g.label = c.label AND g.bin = c.bin""",
    "d AS (SELECT y_signal AS label, sbp AS x FROM obs WHERE y_signal IS NOT NULL AND sbp IS NOT NULL)",
    """st AS (SELECT label,
         CASE WHEN MIN(x) = MAX(x) THEN MIN(x) - 0.5 ELSE MIN(x) END AS lo,
         CASE WHEN MIN(x) = MAX(x) THEN MAX(x) + 0.5 ELSE MAX(x) END AS hi, COUNT(*) AS cnt
       FROM d GROUP BY label)"""), ["bin_lo", "bin_hi", "density"])

# ------------------------------------------------------------------ EVL-10, 11
_RULE_COUNTS = """rc AS (SELECT CAST(CASE WHEN sbp > 120 THEN 1 ELSE 0 END AS DOUBLE) AS score,
    CAST(COUNT(*) FILTER (WHERE y_signal = 1) AS BIGINT) AS pos,
    CAST(COUNT(*) FILTER (WHERE y_signal <> 1) AS BIGINT) AS neg
  FROM obs WHERE y_signal IS NOT NULL GROUP BY 1)"""


def q_binary_performance(spark, sf):
    return finish(ev.binary_performance(_rule(spark, sf), LABEL, "rule_pred", 0.5))


_ctes, _final = metric_sql("rc", [], "0.5e0")
Q["binary_performance"] = q_binary_performance
SQL["binary_performance"] = finish_sql(with_obs(_final, _RULE_COUNTS, *_ctes), METRIC_DOUBLES)


def q_compare_models(spark, sf):
    d = _rule(spark, sf).withColumn("lines_score", F.col("n_lines") / F.lit(8.0))
    return finish(ev.compare_models(d, LABEL, {"rule": ("rule_pred", 0.5), "lines": ("lines_score", 0.5)}))


_MC = """mc AS (SELECT model, score, CAST(COUNT(*) FILTER (WHERE y_signal = 1) AS BIGINT) AS pos,
    CAST(COUNT(*) FILTER (WHERE y_signal <> 1) AS BIGINT) AS neg FROM (
      SELECT 'rule' AS model, CAST(CASE WHEN sbp > 120 THEN 1 ELSE 0 END AS DOUBLE) AS score, y_signal FROM obs
      UNION ALL SELECT 'lines', n_lines / 8.0e0, y_signal FROM obs) u
    WHERE y_signal IS NOT NULL AND score IS NOT NULL GROUP BY model, score)"""
_ctes, _final = metric_sql("mc", ["model"], "0.5e0")
Q["compare_models"] = q_compare_models
SQL["compare_models"] = finish_sql(with_obs(_final, _MC, *_ctes), METRIC_DOUBLES)


# ------------------------------------------------------------------ SPL-1..3
def q_stratified_split(spark, sf):
    return sp.stratified_split(obs(spark, sf).select("id", LABEL), "id", LABEL, 0.2, 11)


_BASE = "base AS (SELECT id, y_signal FROM obs WHERE y_signal IS NOT NULL)"
Q["stratified_split"] = q_stratified_split
SQL["stratified_split"] = with_obs(
    """SELECT r.id, r.y_signal, CASE WHEN r.rk <= a.n_train THEN 'train' ELSE 'test' END AS split
       FROM (SELECT id, y_signal, ROW_NUMBER() OVER (PARTITION BY y_signal ORDER BY """ + md5_sql("11", "id")
    + """, id) AS rk FROM base) r JOIN alloc a ON r.y_signal = a.y""",
    _BASE, ratios_sql([0.2]), *alloc_sql("base", "y_signal"))


def _kfold_sql(k: int, seed: int) -> str:
    return with_obs(
        f"""SELECT r.id, r.y_signal, CAST((o.off + r.rk - 1) % {k} AS INTEGER) AS fold
           FROM (SELECT id, y_signal, ROW_NUMBER() OVER (PARTITION BY y_signal ORDER BY """ + md5_sql(str(seed), "id")
        + """, id) AS rk FROM base) r
           JOIN (SELECT y_signal, COALESCE(SUM(c) OVER (ORDER BY y_signal ROWS BETWEEN UNBOUNDED PRECEDING
                   AND 1 PRECEDING), 0) AS off FROM (SELECT y_signal, COUNT(*) AS c FROM base GROUP BY y_signal) x) o
             ON r.y_signal = o.y_signal""", _BASE)


def q_stratified_kfold(spark, sf):
    return sp.stratified_kfold(obs(spark, sf).select("id", LABEL), "id", LABEL, 5, 11)


def q_stratified_kfold10(spark, sf):
    return sp.stratified_kfold(obs(spark, sf).select("id", LABEL), "id", LABEL, 10, 11)


Q["stratified_kfold"] = q_stratified_kfold
SQL["stratified_kfold"] = _kfold_sql(5, 11)
Q["stratified_kfold10"] = q_stratified_kfold10
SQL["stratified_kfold10"] = _kfold_sql(10, 11)

_SWEEP_COUNTS = [
    "base AS (SELECT id, y_signal, CAST(CASE WHEN sbp > 120 THEN 1 ELSE 0 END AS DOUBLE) AS s "
    "FROM obs WHERE y_signal IS NOT NULL)",
    seeds_sql(), ratios_sql(), *alloc_sql("base", "y_signal"),
    """ranked AS (SELECT seed, b.*, ROW_NUMBER() OVER (PARTITION BY seed, y_signal ORDER BY """
    + md5_sql("seed", "id") + """, id) AS rk FROM base b, seeds)""",
    """sc AS (SELECT r.seed, a.split_ratio, r.s AS score,
         CAST(SUM(CASE WHEN r.y_signal = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(SUM(CASE WHEN r.y_signal = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
       FROM ranked r JOIN alloc a ON r.y_signal = a.y WHERE r.rk > a.n_train GROUP BY ALL)""",
]


def q_split_sweep(spark, sf):
    d = _rule(spark, sf)
    return finish(sp.sweep_test_counts(d, "id", LABEL, "rule_pred", SWEEP_SEEDS, SWEEP_RATIOS))


Q["split_sweep"] = q_split_sweep
SQL["split_sweep"] = finish_sql(with_obs("SELECT * FROM sc", *_SWEEP_COUNTS), ["split_ratio", "score"])


def q_sweep_performance(spark, sf):
    return finish(ev.sweep_performance(_rule(spark, sf), "id", LABEL, "rule_pred",
                                       SWEEP_SEEDS, SWEEP_RATIOS, 0.5))


_ctes, _final = metric_sql("sc", ["seed", "split_ratio"], "0.5e0")
Q["sweep_performance"] = q_sweep_performance
SQL["sweep_performance"] = finish_sql(with_obs(_final, *_SWEEP_COUNTS, *_ctes),
                                      ["split_ratio"] + METRIC_DOUBLES)


def q_sweep_average(spark, sf):
    sw = ev.sweep_performance(_rule(spark, sf), "id", LABEL, "rule_pred", SWEEP_SEEDS, SWEEP_RATIOS, 0.5)
    return finish(ev.sweep_average(sw, ["split_ratio"]))


_avg_cols = []
for _m in ev.SWEEP_METRICS:
    _avg_cols.append(f"AVG(CAST({_m} AS DOUBLE)) AS {_m}_mean")
    _avg_cols.append(f"STDDEV_POP(CAST({_m} AS DOUBLE)) AS {_m}_std")
Q["sweep_average"] = q_sweep_average
SQL["sweep_average"] = finish_sql(with_obs(
    "SELECT split_ratio, COUNT(*) AS n_runs, " + ", ".join(_avg_cols) + " FROM perf GROUP BY split_ratio",
    *_SWEEP_COUNTS, *_ctes, f"perf AS ({_final})"),
    ["split_ratio"] + [c.rsplit(" AS ", 1)[1] for c in _avg_cols])


# ------------------------------------------------------------------ THR-1..3, SET-5
def _thr_input(spark, sf):
    d = sp.stratified_kfold(obs(spark, sf).select("id", LABEL, "n_lines"), "id", LABEL, 10, 11)
    return d.withColumn("score", F.col("n_lines") / F.lit(8.0))


def _thr_sql_ctes() -> list[str]:
    kf = _kfold_sql(10, 11)
    body = kf[kf.index("\nSELECT r.id") + 1:]
    return [
        _BASE,
        f"kf AS ({body})",
        """sd AS (SELECT f.fold, f.y_signal, o.n_lines / 8.0e0 AS score FROM kf f JOIN obs o ON f.id = o.id
                 WHERE o.n_lines IS NOT NULL)""",
        """kc AS (SELECT fold, c0 + CASE WHEN c0 < 980 AND 0.01e0 + c0 * 0.001e0 < score THEN 1 ELSE 0 END
                        - CASE WHEN c0 > 0 AND 0.01e0 + (c0 - 1) * 0.001e0 >= score THEN 1 ELSE 0 END AS k, y_signal
                 FROM (SELECT fold, y_signal, score,
                         CAST(LEAST(GREATEST(ceil((score - 0.01e0) / 0.001e0), 0), 980) AS INTEGER) AS c0 FROM sd) t)""",
        """cts AS (SELECT fold, k, COUNT(*) FILTER (WHERE y_signal = 1) AS pos,
                   COUNT(*) FILTER (WHERE y_signal <> 1) AS neg FROM kc GROUP BY fold, k)""",
        """ft AS (SELECT fold, SUM(pos) AS p, SUM(neg) AS n FROM cts GROUP BY fold)""",
        """grid AS (SELECT ft.fold, ft.p, ft.n, g.k,
                   COALESCE((SELECT SUM(pos) FROM cts c WHERE c.fold = ft.fold AND c.k > g.k), 0) AS tp,
                   COALESCE((SELECT SUM(neg) FROM cts c WHERE c.fold = ft.fold AND c.k > g.k), 0) AS fp
                 FROM ft, (SELECT unnest(range(0, 980)) AS k) g)""",
        """sweep AS (SELECT fold, CAST(k AS INTEGER) AS threshold_idx, 0.01e0 + k * 0.001e0 AS threshold,
                    (CAST(tp AS DOUBLE) / NULLIF(p, 0) + CAST(n - fp AS DOUBLE) / NULLIF(n, 0)) / 2 AS roc_auc
                  FROM grid)""",
    ]


def q_threshold_sweep(spark, sf):
    return finish(ev.threshold_sweep(_thr_input(spark, sf), LABEL, "score", "fold"))


Q["threshold_sweep"] = q_threshold_sweep
SQL["threshold_sweep"] = finish_sql(with_obs("SELECT * FROM sweep", *_thr_sql_ctes()), ["threshold", "roc_auc"])


def q_threshold_avg(spark, sf):
    return finish(ev.threshold_avg(ev.threshold_sweep(_thr_input(spark, sf), LABEL, "score", "fold")))


Q["threshold_avg"] = q_threshold_avg
SQL["threshold_avg"] = finish_sql(with_obs(
    "SELECT threshold_idx, threshold, AVG(roc_auc) AS avg_roc_auc FROM sweep GROUP BY threshold_idx, threshold",
    *_thr_sql_ctes()), ["threshold", "avg_roc_auc"])


def q_best_threshold(spark, sf):
    avg = ev.threshold_avg(ev.threshold_sweep(_thr_input(spark, sf), LABEL, "score", "fold"))
    return finish(ev.best_threshold(avg))


Q["best_threshold"] = q_best_threshold
SQL["best_threshold"] = finish_sql(with_obs(
    """SELECT threshold_idx, threshold, avg_roc_auc FROM (
         SELECT threshold_idx, threshold, AVG(roc_auc) AS avg_roc_auc FROM sweep GROUP BY threshold_idx, threshold) a
       WHERE avg_roc_auc IS NOT NULL ORDER BY avg_roc_auc DESC, threshold_idx LIMIT 1""",
    *_thr_sql_ctes()), ["threshold", "avg_roc_auc"])


def q_threshold_fold_pivot(spark, sf):
    sw = ev.threshold_sweep(_thr_input(spark, sf), LABEL, "score", "fold")
    return finish(ev.threshold_pivot(sw, list(range(10))))


_pv = ", ".join(f"MAX(roc_auc) FILTER (WHERE fold = {i}) AS fold_{i}" for i in range(10))
Q["threshold_fold_pivot"] = q_threshold_fold_pivot
SQL["threshold_fold_pivot"] = finish_sql(with_obs(
    f"SELECT threshold_idx, threshold, {_pv}, AVG(roc_auc) AS avg_roc_auc FROM sweep GROUP BY threshold_idx, threshold",
    *_thr_sql_ctes()), ["threshold", "avg_roc_auc"] + [f"fold_{i}" for i in range(10)])
