"""Scalar expression helpers.

All helpers return ``Column`` expressions so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)

# Largest index of the fixed threshold grid (0.010 + i * 0.001, i = 0..979).
THRESHOLD_INDEX_MAX = 979


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_sum(cols: Iterable[str | Column]) -> Column:
    """``a + b + ...``: NULL as soon as one input is NULL (pandas NaN rule)."""
    cols = [col_of(c) for c in cols]
    if not cols:
        raise ValueError("need at least one column")
    return reduce(lambda a, b: a + b, cols)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL where the denominator is 0 or NULL."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def md5_order_key(seed: int | Column, id_col: str | Column) -> Column:
    """Seeded pseudo-random order: md5 of ``'<seed>:<id>'`` as hex text.

    Spark and DuckDB produce the same digest, so any split or fold derived
    from this order has an exact SQL oracle.
    """
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed_c.cast("string"), F.lit(":"), col_of(id_col).cast("string")))


def hex_bucket(key: str | Column, digits: int = 3) -> Column:
    """Leading ``digits`` hex characters of a digest (16**digits buckets).

    A fixed-length prefix of the lowercase hex text is monotone in the
    digest's text order, so buckets are contiguous ranges of the order and
    can carry per-bucket offsets (two-level ranking).  Kept as text: no
    base conversion per row.
    """
    return F.substring(col_of(key), 1, digits)


def nan_to_null(c: str | Column) -> Column:
    """Map floating NaN to NULL (Spark treats NaN as a value, pandas as missing)."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def numeric_fields(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise if any name is missing (pandas ``drop``/``[]`` strictness)."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise KeyError(f"columns not found: {missing}")
