"""Sums of products of columns, per group, from Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideflow.session import ship_package


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column of equally long rows as a matrix; missing cells are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def packed(rows: DataFrame, folds: str | None = None) -> DataFrame:
    """One row per Arrow batch of ``rows``, which have an array column ``x`` and numbers
    without gaps: ``n`` and every column's values in a row as they lie in memory, so
    that a pass over the stored table decodes nothing.  ``folds``: a column whose distinct
    values of the block are listed under that name."""
    names = rows.columns

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = {"n": pa.array([b.num_rows], pa.int64())}
            for c in names:
                v = (matrix(b.column(c), b.num_rows) if c == "x" else b.column(c).to_numpy(zero_copy_only=False))
                out[c] = pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
            if folds:
                out["folds"] = pa.array([np.unique(b.column(folds).to_numpy()).tolist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, "n long, " + ", ".join(f"{c} binary" for c in names)
                           + (", folds array<int>" if folds else ""))


def blocks(batches, kinds: dict, rows: int = 8192):
    """The columns of a :func:`packed` table as arrays (``x`` a matrix), by so many rows
    at a time; ``kinds``: column -> numpy type."""
    for b in batches:
        for i, n in enumerate(b.column("n").to_pylist()):
            own = [np.frombuffer(b.column(c)[i].as_buffer(), dtype=k) for c, k in kinds.items()]
            own = [v.reshape(n, -1) if c == "x" else v for c, v in zip(kinds, own, strict=True)]
            for at in range(0, n, rows):
                yield [v[at:at + rows] for v in own]


def cross_products(df: DataFrame, group: Column, columns: Sequence[Column]) -> DataFrame:
    """(group, i, j, value): for each group the sum of column i times column j,
    i <= j; rows where either is missing do not count for that pair.

    Every task multiplies its batches as matrices and returns one triangle per
    group that it met; Spark adds them up.
    """
    ship_package(df.sparkSession)
    p = len(columns)
    upper = np.triu_indices(p)
    kind = df.select(group.alias("g")).schema["g"].dataType.simpleString()
    rows = df.select(group.alias("g"), F.array(*[c.cast("double") for c in columns]).alias("x"))

    def run(batches):
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.nan_to_num(matrix(b.column("x"), b.num_rows), nan=0.0)
            keys = b.column("g").dictionary_encode()
            code = keys.indices.to_numpy(zero_copy_only=False)
            for i, key in enumerate(keys.dictionary.to_pylist()):
                own = x[code == i]
                total[key] = total.get(key, 0.0) + (own.T @ own)[upper]
        for key, s in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(s), b.schema.field("g").type), pa.array(upper[0].astype(np.int32)),
                 pa.array(upper[1].astype(np.int32)), pa.array(s)], names=["g", "i", "j", "value"])

    return (rows.where(F.col("g").isNotNull()).mapInArrow(run, f"g {kind}, i int, j int, value double")
            .groupBy("g", "i", "j").agg(F.sum("value").alias("value")))


def matrices(products: DataFrame, p: int) -> dict:
    """group -> p x p matrix, on the driver: groups x p^2 / 2 rows."""
    out: dict = {}
    for r in products.collect():
        m = out.setdefault(r["g"], np.zeros((p, p)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
    return out
