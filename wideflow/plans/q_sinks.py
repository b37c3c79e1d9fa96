"""Registered queries: typed reads with quarantine (SRC-1) and result tables that
a re-run replaces by its own slices (SNK-3..5).  Each writes, partly writes
again, and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideflow.operators import clean as cl
from wideflow.operators import evaluate as ev
from wideflow.operators import profile as pr
from wideflow.plans import q_evaluate as qe
from wideflow.plans import q_models as qm
from wideflow.plans.common import SWEEP_RATIOS, SWEEP_SEEDS, finish, finish_sql, obs, with_obs
from wideflow.session import scratch_path
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


# ------------------------------------------------------------------ SRC-1
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("sbp", T.DoubleType()),
                       T.StructField("lab", T.DoubleType()), T.StructField("grade", T.IntegerType()),
                       T.StructField("txt", T.StringType())])


def _typed(spark, sf) -> DataFrame:
    """obs as a CSV with bad and missing cells here and there, read by its schema."""
    i = F.col("id")
    raw = obs(spark, sf).select(
        "id", F.when(i % 97 == 3, "n/k").when(i % 89 == 5, "NaN").otherwise(F.col("sbp").cast("string")).alias("sbp"),
        F.when(i % 83 == 7, "1,5").otherwise(F.col("lab").cast("string")).alias("lab"),
        F.when(i % 79 == 1, "2.5").when(i % 73 == 2, "NA").otherwise(F.col("grade").cast("string")).alias("grade"), "txt")
    path = scratch_path(spark)
    raw.write.option("header", "true").csv(path)
    return io.read_typed(spark, path, SCHEMA)


@_q("read_typed_csv", finish_sql(with_obs(
    "SELECT id, CASE WHEN id % 97 = 3 OR id % 89 = 5 THEN NULL ELSE sbp END AS sbp, "
    "CASE WHEN id % 83 = 7 THEN NULL ELSE lab END AS lab, "
    "CASE WHEN id % 79 = 1 OR id % 73 = 2 THEN NULL ELSE grade END AS grade, txt FROM obs"), ["sbp", "lab"]))
def q_read_typed_csv(spark, sf):
    """SRC-1: a CSV of obs read by a declared schema; bad and missing cells NULL."""
    return finish(_typed(spark, sf).drop(io.BAD))


@_q("read_quarantine", with_obs(
    "SELECT 'sbp' AS \"column\", 'n/k' AS value, COUNT(*) AS n FROM obs WHERE id % 97 = 3 HAVING COUNT(*) > 0 UNION ALL "
    "SELECT 'lab', '1,5', COUNT(*) FROM obs WHERE id % 83 = 7 HAVING COUNT(*) > 0 UNION ALL "
    "SELECT 'grade', '2.5', COUNT(*) FROM obs WHERE id % 79 = 1 HAVING COUNT(*) > 0"))
def q_read_quarantine(spark, sf):
    """SRC-1: the bad cells of that CSV, counted by column and value."""
    return io.bad_cells(_typed(spark, sf))


# ------------------------------------------------------------------ SNK-3
VARIANTS = ["none", "mode"]


@_q("sink_scores", f"""SELECT s.*, v.variant, CAST(11 AS INTEGER) AS seed, CAST(0.2 AS DOUBLE) AS split_ratio
FROM ({qm.SQL['score_rows']}) s, (SELECT unnest(['none', 'mode']) AS variant) v""")
def q_sink_scores(spark, sf):
    """SNK-3: the score table, one slice per (variant, seed, ratio).  The first run
    of the second variant is wrong; its re-run replaces that slice and no other."""
    rows, path = qm._score_table(spark, sf), scratch_path(spark)

    def slices(names, t):
        keyed = t.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in names])))
        return keyed.withColumn("seed", F.lit(11)).withColumn("split_ratio", F.lit(0.2))

    schema = slices(VARIANTS, rows).schema
    io.write_slices(slices(VARIANTS[:1], rows), path)
    io.write_slices(slices(VARIANTS[1:], rows.withColumn("test_auc", F.lit(0.0))), path)
    io.write_slices(slices(VARIANTS[1:], rows), path)
    return io.read_slices(spark, path, schema)


# ------------------------------------------------------------------ SNK-4
_LISTED = ["n_lines", "l_q", "r_q", "sbp", "dbp", "bmi", "status", "smoke", "const1", "const_null"]


def _features_sql():
    full = " UNION ALL ".join(f"SELECT 'complete' AS method, '{c}' AS feature WHERE (SELECT COUNT({c}) = COUNT(*) FROM obs)"
                              for c in _LISTED)
    many = " UNION ALL ".join(f"SELECT 'varying', '{c}' WHERE (SELECT MIN({c}) < MAX({c}) FROM obs)" for c in _LISTED)
    manual = " UNION ALL ".join(f"SELECT 'manual', '{c}'" for c in qm.MANUAL)
    return with_obs(
        "SELECT CAST(pos AS INTEGER) AS pos, MAX(CASE WHEN method = 'manual' THEN feature END) AS manual, "
        "MAX(CASE WHEN method = 'complete' THEN feature END) AS complete, "
        "MAX(CASE WHEN method = 'varying' THEN feature END) AS varying, 'none' AS variant, "
        "CAST(11 AS INTEGER) AS seed, CAST(0.2 AS DOUBLE) AS split_ratio FROM p GROUP BY pos",
        f"l AS ({full} UNION ALL {many} UNION ALL {manual})",
        "p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY method ORDER BY feature) AS pos FROM l)")


@_q("sink_features", _features_sql())
def q_sink_features(spark, sf):
    """SNK-4: lists of features (chosen by hand, complete, varying) side by side,
    written as a slice twice, with another list first."""
    d = obs(spark, sf).select(*_LISTED)
    p = pr.profile(d, _LISTED).withColumnRenamed("column", "feature")
    rows = (p.where(F.col("n_missing") == 0).select(F.lit("complete").alias("method"), "feature")
            .unionByName(p.where(F.col("n_unique") > 1).select(F.lit("varying").alias("method"), "feature"))
            .unionByName(spark.createDataFrame([("manual", f) for f in qm.MANUAL], "method string, feature string")))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("method").orderBy("feature")))   # columns
    wide = cl.ragged_align(rows, methods=["manual", "complete", "varying"]).withColumns(
        {"variant": F.lit("none"), "seed": F.lit(11), "split_ratio": F.lit(0.2)})
    path = scratch_path(spark)
    io.write_slices(wide.withColumn("manual", F.lit("stale")), path)
    io.write_slices(wide, path)
    return io.read_slices(spark, path, wide.schema)


# ------------------------------------------------------------------ SNK-5
@_q("sink_sweep", qe.SQL["sweep_performance"])
def q_sink_sweep(spark, sf):
    """SNK-5: the sweep's records, one slice per (seed, ratio): the first seeds,
    then all of them again, as after a run that broke."""
    def rows(seeds):
        return finish(ev.sweep_performance(qe._rule(spark, sf), "id", qe.LABEL, "rule_pred", seeds, SWEEP_RATIOS, 0.5))

    path, keys = scratch_path(spark), ("seed", "split_ratio")
    io.write_slices(rows(SWEEP_SEEDS[:2]), path, keys)
    whole = rows(SWEEP_SEEDS)
    io.write_slices(whole, path, keys)
    return io.read_slices(spark, path, whole.schema)
