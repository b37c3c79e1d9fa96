"""AGG-1..5, FLT-3..5: column and row profiles and the drops they drive.

Column statistics for any number of columns come from **one** aggregation
(one scan).  Exact distinct counts avoid one ``COUNT(DISTINCT)`` per column
(an Expand that multiplies the rows by the column count): the table is
unpivoted to (column, value), de-duplicated with map-side combine, and
counted per column.  Constant columns use ``min = max`` instead, which needs
no distinct at all.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(df.columns if cols is None else cols)


def _as_text(df: DataFrame, c: str) -> Column:
    """The value as text; -0.0 and 0.0 are one value."""
    floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
    return (F.col(c) + F.lit(0.0) if floating else F.col(c)).cast("string")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_rows, n_missing, missing_pct) from one aggregation pass."""
    cols = _cols(df, cols)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("n_missing"))
                                for i, c in enumerate(cols)])).alias("p")
    long = row.select(F.col("__n").alias("n_rows"), pairs).select("p.column", "n_rows", "p.n_missing")
    return long.select("column", "n_rows", "n_missing",
                       (F.col("n_missing") * 100.0 / F.col("n_rows")).alias("missing_pct"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG-3: (column, n_unique), exact, missing not counted; an all-missing
    column has no row here (``profile`` reports it with 0)."""
    cols = _cols(df, cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in cols]))
        .alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
    per_value = long.distinct()
    return per_value.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


def approx_distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, rsd: float = 0.01) -> DataFrame:
    """AGG-3 option for very wide, high-cardinality tables: HyperLogLog++
    sketches in the same single aggregation (no de-duplication shuffle)."""
    cols = _cols(df, cols)
    row = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"__u{i}") for i, c in enumerate(cols)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__u{i}").alias("n_unique"))
                                for i, c in enumerate(cols)])).alias("p")
    return row.select(pairs).select("p.column", "p.n_unique")


def profile(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """AGG-1 + AGG-3: (column, n_rows, n_missing, missing_pct, n_unique).

    Exact form in **one scan**: every cell becomes (column, value-as-text,
    NULL kept), counted per distinct (column, value) with map-side combine;
    per column, the counts add up to the row count, the NULL bucket is the
    missing count and the non-NULL buckets are the distinct values.
    """
    if not exact:
        m = missing_counts(df, cols)
        u = approx_distinct_counts(df, cols)
        return (m.join(u, on="column", how="left")
                 .withColumn("n_unique", F.coalesce(F.col("n_unique"), F.lit(0)).cast("bigint")))
    cols = _cols(df, cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in cols]))
        .alias("p")).select("p.column", "p.value")
    per_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    out = per_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_unique"))
    return out.select("column", "n_rows", "n_missing",
                      (F.col("n_missing") * 100.0 / F.col("n_rows")).alias("missing_pct"),
                      F.col("n_unique").cast("bigint").alias("n_unique"))


def row_missing_pct(df: DataFrame, id_col: str, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG-2: (id, n_missing, missing_pct) across the columns of each row."""
    cols = _cols(df, cols)
    n_missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])
    return df.select(F.col(id_col), n_missing.alias("n_missing"),
                     (n_missing * 100.0 / F.lit(len(cols))).alias("missing_pct"))


def shape(df: DataFrame) -> DataFrame:
    """AGG-4: (n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("int").alias("n_columns"))


def total_missing(df: DataFrame) -> DataFrame:
    """AGG-5: one row with the number of missing cells of the whole table."""
    expr = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(expr.cast("bigint").alias("total_missing"))


def assert_complete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG-5: fail the job if any cell (of ``cols``) is missing, else pass
    ``df`` through.

    The check runs inside the job (``raise_error``), not on the driver.
    """
    if not _cols(df, cols):
        return df
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in _cols(df, cols)])
    guard = F.when(any_null, F.raise_error(F.lit("missing values remain after imputation")))
    return df.where(guard.isNull())


# ------------------------------------------------------------------ drops
def sparse_columns(df: DataFrame, max_pct: float = 10.0, cols: Sequence[str] | None = None) -> list[str]:
    """Names whose missing share is strictly above ``max_pct`` (one job)."""
    rows = missing_counts(df, cols).where(F.col("missing_pct") > max_pct).select("column").collect()
    return [r[0] for r in rows]


def drop_sparse_columns(df: DataFrame, max_pct: float = 10.0) -> DataFrame:
    """FLT-3: drop columns with more than ``max_pct`` % missing (strict ``>``)."""
    return df.drop(*sparse_columns(df, max_pct))


def row_missing_share(cols: Sequence[str]) -> Column:
    n_missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])
    return n_missing * 100.0 / F.lit(len(cols))


def drop_sparse_rows(df: DataFrame, max_pct: float = 10.0) -> DataFrame:
    """FLT-4: drop rows with more than ``max_pct`` % of their cells missing;
    the denominator is the number of columns of ``df`` (a pure row filter)."""
    return df.where(row_missing_share(df.columns) <= max_pct)


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with exactly one distinct non-missing value (``min = max``).

    An all-missing column has no value and is *not* constant (as in the
    reference, where its distinct count is 0).
    """
    cols = _cols(df, cols)
    row = df.agg(*[(F.min(c) == F.max(c)).alias(f"__c{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"__c{i}"] is True]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """FLT-5: drop columns whose only non-missing value is one constant."""
    return df.drop(*constant_columns(df))
