"""FLT-1, 2, 6; PRJ-7..11; SET-1..4: row filters, role lists, alignment."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideflow.functions.expr import numeric_fields, require_columns


# ------------------------------------------------------------------ filters
def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FLT-1: drop rows missing any of ``cols`` (e.g. the label)."""
    return df.dropna(subset=list(cols))


def filter_not_equal(df: DataFrame, col: str, value) -> DataFrame:
    """FLT-2: keep rows whose value differs from ``value``, **including
    missing ones** (pandas: NaN != 1 is True; SQL ``<>`` would drop them)."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def exclude_features(df: DataFrame, names: Iterable[str], col: str = "feature") -> DataFrame:
    """FLT-6: drop rows of a (feature, ...) table whose feature is listed."""
    names = list(names)
    return df.where(~F.col(col).isin(names)) if names else df


# ------------------------------------------------------------------ projections
def numeric_only(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """PRJ-7: keep numeric columns (strings and other types silently dropped)."""
    return df.select(*numeric_fields(df, exclude))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-7: non-convertible values become NULL (``try_cast`` to double)."""
    sel = [F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in set(cols) else F.col(c) for c in df.columns]
    return df.select(*sel)


def dedupe(names: Iterable[str]) -> list[str]:
    """De-duplicate keeping first occurrence order."""
    return list(dict.fromkeys(names))


def feature_roles(df: DataFrame, categoric: Sequence[str], label: str, id_col: str | None = None
                  ) -> list[tuple[str, str]]:
    """PRJ-8: (feature, role) for role in categoric / numeric / label / id.

    Categoric names are de-duplicated and intersected with the table (a
    listed name that was dropped as sparse is skipped, not an error);
    numeric = numeric columns minus label, id and categoric names.
    """
    have = set(df.columns)
    cat = [c for c in dedupe(categoric) if c in have and c not in (label, id_col)]
    num = [c for c in numeric_fields(df, exclude=[label] + ([id_col] if id_col else []))
           if c not in set(cat)]
    roles = [(c, "categoric") for c in cat] + [(c, "numeric") for c in num] + [(label, "label")]
    if id_col:
        roles.append((id_col, "id"))
    return roles


def select_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-9 / FS-1: keep the listed features (strict) plus key columns."""
    cols = dedupe(list(keep) + list(features))
    require_columns(df, cols)
    return df.select(*cols)


def display_names(features: DataFrame, names: DataFrame, col: str = "feature") -> DataFrame:
    """PRJ-10: add ``display_name`` = mapped label, falling back to the code.

    ``names`` is a (feature, label) lookup; it is a left join, so a feature
    without an entry keeps its own name.
    """
    lk = names.select(F.col(col).alias("__k"), F.col("label").alias("__label"))
    j = features.join(lk, features[col] == lk["__k"], "left")
    return j.select(*[features[c] for c in features.columns],
                    F.coalesce(F.col("__label"), features[col]).alias("display_name"))


def positive_prob(df: DataFrame, prob_col: str = "probability", out: str = "p1") -> DataFrame:
    """PRJ-11: probability of class 1 from a Spark ML probability vector;
    more than two classes fails the job (binary problem required)."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(prob_col))
    guard = F.when(F.size(arr) > 2, F.raise_error(F.lit("A binary class problem is required")))
    return df.withColumn(out, F.coalesce(guard.cast("double"), arr[1]))


# ------------------------------------------------------------------ alignment
def align_on_id(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """SET-1: column-wise concat aligned on a row id (full outer join).

    Columns present on both sides come from ``left`` (missing filled from
    ``right``); a duplicate name never appears twice.
    """
    shared = [c for c in right.columns if c in set(left.columns) and c != id_col]
    r = right.select(F.col(id_col), *[F.col(c).alias(f"__r_{c}") if c in shared else F.col(c)
                                       for c in right.columns if c != id_col])
    j = left.join(r, on=id_col, how="full_outer")
    sel = [F.col(id_col)]
    for c in left.columns:
        if c == id_col:
            continue
        sel.append(F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if c in shared else F.col(c))
    sel += [F.col(c) for c in right.columns if c != id_col and c not in shared]
    return j.select(*sel)


def feature_overlap(a: DataFrame, b: DataFrame, col: str = "feature") -> DataFrame:
    """SET-2: features in both lists (``intersect``, duplicates removed)."""
    return a.select(col).intersect(b.select(col))


def feature_minus(a: DataFrame, b: DataFrame, col: str = "feature") -> DataFrame:
    """SET-2: features of ``a`` not in ``b`` keeping ``a``'s other columns
    (e.g. its position), as a left anti join."""
    return a.join(b.select(col), on=col, how="left_anti")


def ragged_align(lists: DataFrame, method: str = "method", pos: str = "pos",
                 feature: str = "feature", methods: Sequence[str] | None = None) -> DataFrame:
    """SET-3: lists of unequal length side by side by position, padded with
    NULL: long (method, pos, feature) -> one column per method."""
    g = lists.groupBy(pos)
    g = g.pivot(method, list(methods)) if methods is not None else g.pivot(method)
    return g.agg(F.first(feature))


def append_results(*dfs: DataFrame) -> DataFrame:
    """SET-4: stack result rows (columns matched by name, missing -> NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
