"""SRC-1..3 and SNK-1..5: columnar reads and writes.

Excel workbooks are re-aimed to Parquet datasets: a workbook sheet becomes a
``variant=<name>`` partition, so reading one sheet is partition pruning.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideflow.functions.expr import nan_to_null

VARIANT = "variant"


def clean_nan(df: DataFrame) -> DataFrame:
    """SRC-1 post-step: floating NaN becomes NULL in every float/double column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """SRC-1: read a table (Parquet or headered CSV), NaN -> NULL on load."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    return clean_nan(reader.format(fmt).load(path))


def read_variant(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """SRC-2: one named variant of a dataset (partition pruned at the scan)."""
    return clean_nan(spark.read.parquet(path).where(F.col(VARIANT) == variant).drop(VARIANT))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: every variant of a dataset, with the ``variant`` column."""
    return clean_nan(spark.read.parquet(path))


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = (),
                mode: str = "overwrite", fmt: str = "parquet") -> None:
    """SNK-1..5: write without an index column; optional partition columns."""
    w = df.write.mode(mode).format(fmt)
    parts = list(partition_by)
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        w = w.option("header", "true")
    w.save(path)


# ------------------------------------------------------------------ typed reads with quarantine
#: Texts that stand for a missing cell.
MISSING = ("", "NaN", "nan", "NA", "N/A", "null", "None")
BAD = "_bad"


def read_typed(spark: SparkSession, path: str, schema: T.StructType, missing: Iterable[str] = MISSING) -> DataFrame:
    """SRC-1: a headered CSV read by a declared schema, with bad cells set apart.

    Returns the schema's columns and ``_bad``: an array of (column, value), one for
    each cell that is neither of the declared type nor one of the ``missing``
    texts; such cells, and missing ones, are NULL.  A line with too few or too
    many cells gives the cells that it has and a bad cell (``_line``, the line).
    Infinite and NaN numbers are NULL.  One scan: cells are read as text and
    cast, so nothing is inferred from the data.
    """
    line = "_line"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]
                        + [T.StructField(line, T.StringType())])
    raw = (spark.read.schema(text).option("header", "true").option("mode", "PERMISSIVE").option("enforceSchema", "true")
           .option("columnNameOfCorruptRecord", line).option("escape", '"').option("nullValue", "").csv(path))
    marks = list(missing)
    typed, bad = [], []
    for f in schema.fields:
        cell = F.when(F.trim(F.col(f"`{f.name}`")).isin(marks), None).otherwise(F.col(f"`{f.name}`"))
        value = cell if isinstance(f.dataType, T.StringType) else cell.try_cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
        typed.append(value.alias(f.name))
        bad.append(F.when(cell.isNotNull() & value.isNull(), F.struct(
            F.lit(f.name).alias("column"), cell.alias("value"))))
    bad.append(F.when(F.col(line).isNotNull(), F.struct(F.lit(line).alias("column"), F.col(line).alias("value"))))
    return raw.select(*typed, F.filter(F.array(*bad), lambda x: x.isNotNull()).alias(BAD))


def bad_cells(typed: DataFrame) -> DataFrame:
    """(column, value, n): the quarantined cells of a typed read, counted."""
    return (typed.select(F.explode(BAD).alias("b")).groupBy(F.col("b.column").alias("column"), F.col("b.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ result tables
#: What a run of the reference is told apart by.
RUN_KEYS = ("variant", "seed", "split_ratio")


def write_slices(df: DataFrame, path: str, keys: Iterable[str] = RUN_KEYS) -> None:
    """SNK-3..5: append result rows so that a re-run replaces its own slices: the
    partitions (one per value of ``keys``) that ``df`` has rows for are overwritten,
    the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_slices(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All slices of a result table.  The schema is given, so the types of the keys
    are not guessed from folder names."""
    return spark.read.schema(schema).parquet(path)
