"""The ``obs`` table: one row per order standing in for one participant.

The reference ships no data, so every query runs on this projection of the
driver's ``orders``, ``lineitem`` and ``customer`` tables.  Missingness is
made by deterministic expressions so Spark and DuckDB agree cell by cell.
All per-order sums are over integers (units, cents, percent points).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _tbl(spark, sf_dir, "orders")
    li = _tbl(spark, sf_dir, "lineitem")
    cu = _tbl(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    q = F.col("l_quantity").cast("bigint")
    p = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    d = F.round(F.col("l_discount") * 100).cast("bigint")
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min(q).alias("q_min"), F.max(q).alias("q_max"), F.sum(q).alias("q_sum"),
        F.min(p).alias("p_min"), F.max(p).alias("p_max"), F.sum(p).alias("p_cents"),
        F.min(d).alias("d_min"), F.max(d).alias("d_max"), F.sum(d).alias("d_pct"),
    )
    # the customer first, while an order is few columns wide
    j = (o.join(cu, o.o_custkey == cu.c_custkey, "left")
          .join(per_order, o.o_orderkey == per_order.l_orderkey, "left"))
    i = F.col("o_orderkey")
    grade = F.substring("o_orderpriority", 1, 1).cast("int")
    dbl = lambda c: F.col(c).cast("double")
    return j.select(
        i.alias("id"),
        F.col("n_lines"),
        F.when(i % 23 != 7, dbl("q_min")).alias("l_q"),
        dbl("q_max").alias("r_q"),
        dbl("p_min").alias("l_p"),
        F.when(i % 31 != 4, dbl("p_max")).alias("r_p"),
        dbl("d_min").alias("l_d"),
        dbl("d_max").alias("r_d"),
        (dbl("q_sum") / F.col("n_lines") * 4 + 20).alias("sbp"),
        (dbl("d_pct") / F.col("n_lines") * 8 + 45).alias("dbp"),
        (F.lit(15.0) + ((i * 7919) % 2000) / F.lit(100.0)).alias("bmi"),
        (F.col("o_custkey") % 2).cast("int").alias("sex"),
        (F.col("o_custkey") % 3).cast("int").alias("ethnicity"),
        grade.alias("grade"),
        F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 0)
         .cast("int").alias("status"),
        F.when(i % 29 == 1, F.lit(None)).when(i % 3 == 0, 1).otherwise(0).cast("int").alias("smoke"),
        F.col("c_acctbal").alias("lab"),
        F.when(i % 5 != 0, F.col("o_totalprice")).alias("sparse20"),
        F.when(i % 10 != 0, F.col("o_totalprice")).alias("sparse10"),
        F.lit(1).cast("int").alias("const1"),
        F.when(i % 13 != 0, F.lit(1)).cast("int").alias("const_null"),
        F.col("o_orderpriority").alias("txt"),
        F.when(i % 101 == 0, F.lit(None)).when(F.col("p_cents") > 20000000, 1).otherwise(0)
         .cast("int").alias("y_signal"),
        F.when(grade.isin(1, 2), 1).otherwise(0).cast("int").alias("y_noise"),
    )


# DuckDB text of the same table, used as a CTE by every oracle query.
OBS_SQL = """
obs_lines AS (
  SELECT l_orderkey,
         COUNT(*) AS n_lines,
         MIN(CAST(l_quantity AS BIGINT)) AS q_min,
         MAX(CAST(l_quantity AS BIGINT)) AS q_max,
         SUM(CAST(l_quantity AS BIGINT)) AS q_sum,
         MIN(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS p_min,
         MAX(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS p_max,
         SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS p_cents,
         MIN(CAST(ROUND(l_discount * 100) AS BIGINT)) AS d_min,
         MAX(CAST(ROUND(l_discount * 100) AS BIGINT)) AS d_max,
         SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS d_pct
  FROM lineitem GROUP BY l_orderkey
),
obs AS (
  SELECT o.o_orderkey AS id,
         a.n_lines,
         CASE WHEN o.o_orderkey % 23 <> 7 THEN CAST(a.q_min AS DOUBLE) END AS l_q,
         CAST(a.q_max AS DOUBLE) AS r_q,
         CAST(a.p_min AS DOUBLE) AS l_p,
         CASE WHEN o.o_orderkey % 31 <> 4 THEN CAST(a.p_max AS DOUBLE) END AS r_p,
         CAST(a.d_min AS DOUBLE) AS l_d,
         CAST(a.d_max AS DOUBLE) AS r_d,
         CAST(a.q_sum AS DOUBLE) / a.n_lines * 4 + 20 AS sbp,
         CAST(a.d_pct AS DOUBLE) / a.n_lines * 8 + 45 AS dbp,
         15.0e0 + ((o.o_orderkey * 7919) % 2000) / 100.0e0 AS bmi,
         CAST(o.o_custkey % 2 AS INTEGER) AS sex,
         CAST(o.o_custkey % 3 AS INTEGER) AS ethnicity,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS grade,
         CAST(CASE o.o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 0 END AS INTEGER) AS status,
         CAST(CASE WHEN o.o_orderkey % 29 = 1 THEN NULL WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END
              AS INTEGER) AS smoke,
         c.c_acctbal AS lab,
         CASE WHEN o.o_orderkey % 5 <> 0 THEN o.o_totalprice END AS sparse20,
         CASE WHEN o.o_orderkey % 10 <> 0 THEN o.o_totalprice END AS sparse10,
         CAST(1 AS INTEGER) AS const1,
         CAST(CASE WHEN o.o_orderkey % 13 <> 0 THEN 1 END AS INTEGER) AS const_null,
         o.o_orderpriority AS txt,
         CAST(CASE WHEN o.o_orderkey % 101 = 0 THEN NULL WHEN a.p_cents > 20000000 THEN 1 ELSE 0 END
              AS INTEGER) AS y_signal,
         CAST(CASE WHEN CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) IN (1, 2) THEN 1 ELSE 0 END
              AS INTEGER) AS y_noise
  FROM orders o
  LEFT JOIN obs_lines a ON o.o_orderkey = a.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""


def with_obs(body: str, *ctes: str) -> str:
    """Prefix an oracle query with the ``obs`` CTE (and any further CTEs)."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {OBS_SQL.strip()}{extra}\n{body}"


# Column order of ``obs`` and the double-typed ones (for generated SQL).
OBS_COLUMNS = ["id", "n_lines", "l_q", "r_q", "l_p", "r_p", "l_d", "r_d", "sbp", "dbp", "bmi", "sex",
               "ethnicity", "grade", "status", "smoke", "lab", "sparse20", "sparse10", "const1",
               "const_null", "txt", "y_signal", "y_noise"]
OBS_DOUBLES = ["l_q", "r_q", "l_p", "r_p", "l_d", "r_d", "sbp", "dbp", "bmi", "lab", "sparse20", "sparse10"]
