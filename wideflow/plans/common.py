"""Shared pieces of the registered queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideflow.sources.fixtures import obs, with_obs  # noqa: F401

DIGITS = 6

# Fixed values of the reference's split sweep: seeds and test shares.
SWEEP_SEEDS = [1, 7, 11, 17, 21, 42, 107, 210, 1007, 2025, 11795]
SWEEP_RATIOS = [0.125, 0.15, 0.175, 0.2, 0.225, 0.25, 0.275, 0.3, 0.8, 0.9, 0.99]


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (float sums depend on summation order)."""
    cols = [F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def finish_sql(sql: str, doubles: list[str], digits: int = DIGITS) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"ROUND({c}, {digits}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def seeds_sql(seeds=SWEEP_SEEDS) -> str:
    return "seeds AS (SELECT CAST(unnest([" + ", ".join(str(s) for s in seeds) + "]) AS INTEGER) AS seed)"


def ratios_sql(ratios=SWEEP_RATIOS) -> str:
    vals = ", ".join(f"({i}, {r!r}::DOUBLE)" for i, r in enumerate(ratios))
    return f"ratios AS (SELECT * FROM (VALUES {vals}) t(ratio_idx, split_ratio))"


def md5_sql(seed: str, id_col: str) -> str:
    return f"md5(CAST({seed} AS VARCHAR) || ':' || CAST({id_col} AS VARCHAR))"


def alloc_sql(base: str, label: str, ratios_cte: str = "ratios", name: str = "alloc") -> list[str]:
    """Largest-remainder train allocation per (ratio, class) as CTEs."""
    return [
        f"""{name}_c AS (SELECT {label} AS y, COUNT(*) AS n_class FROM {base} GROUP BY {label})""",
        f"""{name}_0 AS (SELECT r.ratio_idx, r.split_ratio, c.y, c.n_class,
                 SUM(c.n_class) OVER (PARTITION BY r.ratio_idx) AS n
               FROM {name}_c c, {ratios_cte} r)""",
        f"""{name}_1 AS (SELECT *, n - CAST(ceil(split_ratio * n) AS BIGINT) AS n_train_all FROM {name}_0)""",
        f"""{name}_2 AS (SELECT *, floor(CAST(n_class AS DOUBLE) / n * n_train_all) AS fl,
                 CAST(n_class AS DOUBLE) / n * n_train_all - floor(CAST(n_class AS DOUBLE) / n * n_train_all) AS rem
               FROM {name}_1)""",
        f"""{name}_3 AS (SELECT *, n_train_all - SUM(fl) OVER (PARTITION BY ratio_idx) AS need,
                 ROW_NUMBER() OVER (PARTITION BY ratio_idx ORDER BY rem DESC, y) AS pos FROM {name}_2)""",
        f"""{name} AS (SELECT ratio_idx, split_ratio, y, n_class,
                 CAST(fl + CASE WHEN pos <= need THEN 1 ELSE 0 END AS BIGINT) AS n_train FROM {name}_3)""",
    ]


def metric_sql(counts: str, groups: list[str], thresh: str, as_coded: bool = False,
               name: str = "perf") -> tuple[list[str], str]:
    """CTEs computing the metric record from a (groups, score, pos, neg) CTE.

    Returns (ctes, final select).  ``thresh`` is an SQL expression.
    """
    g = ", ".join(groups)
    gp = (g + ", ") if groups else ""
    part = f"PARTITION BY {g}" if groups else ""
    on = " AND ".join(f"a.{c} = b.{c}" for c in groups) or "TRUE"
    ctes = [
        f"""{name}_scan AS (SELECT {gp}score, pos, neg,
              SUM(pos) OVER w AS cum_pos, SUM(neg) OVER w AS cum_neg
            FROM {counts}
            WINDOW w AS ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""{name}_area AS (SELECT {gp}
              SUM(pos) AS p, SUM(neg) AS n,
              SUM(neg * (2 * cum_pos - pos)) AS roc2,
              SUM(pos * (cum_pos / (cum_pos + cum_neg)
                   + CASE WHEN cum_pos - pos + cum_neg - neg = 0 THEN 1.0e0
                          ELSE (cum_pos - pos) / (cum_pos - pos + cum_neg - neg) END)) AS pr2
            FROM {name}_scan {"GROUP BY " + g if groups else ""})""",
        f"""{name}_cm AS (SELECT {gp}
              CAST(SUM(CASE WHEN score > {thresh} THEN 0 ELSE neg END) AS BIGINT) AS tn,
              CAST(SUM(CASE WHEN score > {thresh} THEN neg ELSE 0 END) AS BIGINT) AS fp,
              CAST(SUM(CASE WHEN score > {thresh} THEN 0 ELSE pos END) AS BIGINT) AS fn,
              CAST(SUM(CASE WHEN score > {thresh} THEN pos ELSE 0 END) AS BIGINT) AS tp
            FROM {counts} {"GROUP BY " + g if groups else ""})""",
    ]
    acc_den = "(tp + fp + tn + fp)" if as_coded else "(tp + tn + fp + fn)"
    sel_g = ", ".join(f"a.{c}" for c in groups)
    final = f"""SELECT {sel_g + ", " if groups else ""}CAST({thresh} AS DOUBLE) AS decision_threshold,
       tn, fp, fn, tp,
       CAST(tp + tn AS DOUBLE) / NULLIF({acc_den}, 0) AS accuracy,
       CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision,
       CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall,
       2.0e0 * (CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)) * (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0))
         / NULLIF(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) + CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS f1_score,
       CAST(roc2 AS DOUBLE) / NULLIF(2 * p * n, 0) AS auc,
       pr2 / NULLIF(2 * p, 0) AS pr_auc
FROM {name}_cm a JOIN {name}_area b ON {on}"""
    return ctes, final


METRIC_DOUBLES = ["decision_threshold", "accuracy", "precision", "recall", "f1_score", "auc", "pr_auc"]


def auc_sql(counts: str, groups: list[str], name: str = "auc") -> list[str]:
    """CTEs giving (groups, auc) from a (groups, score, pos, neg) CTE."""
    g = ", ".join(groups)
    return [
        f"""{name}_scan AS (SELECT {g}, score, pos, neg,
              SUM(pos) OVER w AS cum_pos, SUM(neg) OVER w AS cum_neg FROM {counts}
            WINDOW w AS (PARTITION BY {g} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""{name} AS (SELECT {g}, CAST(SUM(neg * (2 * cum_pos - pos)) AS DOUBLE) / NULLIF(2 * SUM(pos) * SUM(neg), 0)
              AS auc FROM {name}_scan GROUP BY {g})""",
    ]
