"""SCL-1 / PRJ-12: min-max scaling fitted on one split, applied to any.

Written as expressions, not ``ml.MinMaxScaler``: the reference library maps
a constant column to ``x - min`` (0 on the fit rows), Spark's scaler to 0.5.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MinMaxModel:
    def __init__(self, cols: Sequence[str], mins: dict, maxs: dict):
        self.cols, self.mins, self.maxs = list(cols), mins, maxs

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str]) -> "MinMaxModel":
        """One aggregation: min and max of every column (2 x columns values)."""
        row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(cols)],
                     *[F.max(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)]).first()
        return MinMaxModel(cols, {c: row[f"n{i}"] for i, c in enumerate(cols)},
                           {c: row[f"x{i}"] for i, c in enumerate(cols)})

    def expr(self, c: str):
        lo, hi = self.mins[c], self.maxs[c]
        x = F.col(c).cast("double")
        if lo is None:
            return x
        rng = hi - lo
        scale = 1.0 / rng if rng != 0 else 1.0
        return x * F.lit(scale) + F.lit(-lo * scale)

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled values replace the fitted columns; other columns are kept."""
        cols = set(self.cols)
        return df.select(*[self.expr(c).alias(c) if c in cols else F.col(c) for c in df.columns])
