"""XPL-1..5: Shapley values, importance, partial dependence.

A *predictor* is any function ``DataFrame -> DataFrame`` that adds a double
column ``__f`` (a fitted pipeline's class or probability, or a plain
expression).  Any predictor can be explained: the perturbed rows are built with
``explode`` over a grid whose size is fixed by the parameters (permutations x
background rows x features, or grid points) -- never by the data -- and
scored with one distributed ``transform``.  A predictor that also tells its
weights and link (:class:`Additive`, as the linear ones do) has the same
perturbed rows scored inside the tasks, batch by batch as matrices: the rows
that Spark handles are then those of the input.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wideflow.functions.cross import matrix
from wideflow.functions.expr import md5_order_key
from wideflow.functions.ranking import ordered_scan
from wideflow.operators.impute import value_counts
from wideflow.session import ship_package

Predictor = Callable[[DataFrame], DataFrame]
#: Perturbed rows that a task scores at a time.
CELLS_AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Additive:
    """A predictor's score as a function of a weighted sum: ``link`` is 'identity',
    'logistic' or 'class' (1 if the sum is above ``limit``).  ``strict``: missing
    cells raise, as they do in a fitted pipeline; else the score is missing."""
    weights: dict[str, float]
    bias: float = 0.0
    link: str = "identity"
    limit: float = 0.0
    strict: bool = False

    def scores(self, margins: np.ndarray) -> np.ndarray:
        if self.link == "identity":
            return margins
        if self.link == "class":
            return margins > self.limit
        return 1 / (1 + np.exp(-margins))


def _additive(model, output: str) -> Additive | None:
    """What :class:`Additive` says of a fitted pipeline; None if it is not an
    assembler and a two-class logistic regression."""
    stages = getattr(model, "stages", [])
    if len(stages) != 2 or not isinstance(stages[1], LogisticRegressionModel) or stages[1].numClasses != 2:
        return None
    asm, lr = stages
    columns, weights = asm.getInputCols(), lr.coefficients.toArray()
    if lr.isSet("thresholds") or len(columns) != len(weights) or asm.getHandleInvalid() != "error":
        return None
    t = lr.getThreshold()
    limit = -math.inf if t <= 0 else math.inf if t >= 1 else math.log(t / (1 - t))
    return Additive(dict(zip(columns, weights.tolist(), strict=True)), float(lr.intercept),
                    "class" if output == "prediction" else "logistic", limit, True)


def model_predictor(model, output: str = "prediction") -> Predictor:
    """Wrap a fitted pipeline: ``output`` = 'prediction' (class, as the
    reference explains) or 'p1' (probability of class 1)."""
    from wideflow.operators.models import predict

    def run(df: DataFrame) -> DataFrame:
        out = predict(model, df)
        return out.withColumn("__f", F.col("prediction" if output == "prediction" else "p1").cast("double"))
    run.additive = _additive(model, output)
    return run


def linear_predictor(weights: dict[str, float], bias: float = 0.0) -> Predictor:
    def run(df: DataFrame) -> DataFrame:
        s = F.lit(float(bias))
        for f, w in weights.items():
            s = s + F.col(f).cast("double") * F.lit(float(w))
        return df.withColumn("__f", s)
    run.additive = Additive({f: float(w) for f, w in weights.items()}, float(bias))
    return run


def background(df: DataFrame, id_col: str, features: Sequence[str], n: int = 100,
               seed: int = 0) -> list[list[float]]:
    """The first ``n`` rows in a seeded md5 order, complete rows only.

    A top-n (each task keeps n rows), so the driver receives n x p values.
    """
    d = df.select(id_col, *features).dropna(subset=list(features))
    rows = d.orderBy(md5_order_key(f"bg{seed}", id_col), F.col(id_col)).limit(n).collect()
    return [[float(r[f]) for f in features] for r in rows]


def permutations(p: int, n_perm: int, seed: int = 0) -> list[list[int]]:
    """Seeded feature orders (md5 draws, reproducible anywhere)."""
    out = []
    for k in range(n_perm):
        keys = [hashlib.md5(f"{seed}:{k}:{j}".encode()).hexdigest() for j in range(p)]
        out.append(sorted(range(p), key=lambda j: keys[j]))
    return out


def shapley_values(predict_fn: Predictor, df: DataFrame, id_col: str, features: Sequence[str],
                   bg: list[list[float]], n_perm: int = 2, seed: int = 0) -> DataFrame:
    """XPL-1 / XPL-5: (id, feature, phi, value) by permutation sampling.

    For a row x, a feature order pi and a background row b, the hybrid at
    step j takes the first j features of pi from x and the rest from b;
    phi_f averages f(step j) - f(step j-1) over (pi, b) where pi[j-1] = f.
    The sum of phi over features equals f(x) - mean_b f(b) exactly.
    """
    feats = list(features)
    p = len(feats)
    perms = permutations(p, n_perm, seed)
    form = getattr(predict_fn, "additive", None)
    if form is not None and set(form.weights) <= set(feats) and len(set(feats)) == p and bg:
        return _shapley_additive(form, df, id_col, feats, bg, perms)
    pos = [[perm.index(i) for i in range(p)] for perm in perms]   # position of feature i in perm k
    combos = F.explode(F.array(*[F.struct(F.lit(k).alias("__k"), F.lit(b).alias("__b"), F.lit(j).alias("__j"))
                                 for k in range(n_perm) for b in range(len(bg)) for j in range(p + 1)]))
    d = df.select(F.col(id_col).alias("__id"), *feats, combos.alias("__c")).select("__id", *feats, "__c.*")
    hybrid = []
    for i, f in enumerate(feats):
        at = F.element_at(F.array(*[F.lit(pos[k][i]) for k in range(n_perm)]), F.col("__k") + 1)
        bval = F.element_at(F.array(*[F.lit(row[i]) for row in bg]), F.col("__b") + 1)
        hybrid.append(F.when(at < F.col("__j"), F.col(f).cast("double")).otherwise(bval).alias(f))
    # The row's own values ride along as one array: no join back.
    own = F.array(*[F.col(f).cast("double") for f in feats]).alias("__x")
    h = predict_fn(d.select("__id", "__k", "__j", own, *hybrid)).select("__id", "__k", "__j", "__x", "__f")
    # A hybrid adds to the feature it has just taken and takes from the one it
    # takes next, so phi is a signed sum, combined before the shuffle.
    order = F.element_at(F.array(*[F.array(*[F.lit(i) for i in perm]) for perm in perms]), F.col("__k") + 1)
    signed = F.explode(F.filter(F.array(
        F.struct(F.get(order, F.col("__j") - 1).alias("i"), F.col("__f").alias("d")),
        F.struct(F.get(order, F.col("__j")).alias("i"), (-F.col("__f")).alias("d"))),
        lambda s: s.getField("i").isNotNull()))
    phi = (h.select("__id", "__x", signed.alias("s"))
           .groupBy("__id", F.col("s.i").alias("__i"))
           .agg((F.sum("s.d") / F.lit(n_perm * len(bg))).alias("phi"),
                F.first(F.get("__x", F.col("s.i"))).alias("value")))
    names = F.array(*[F.lit(f) for f in feats])
    return phi.select(F.col("__id").alias(id_col), F.get(names, F.col("__i")).alias("feature"), "phi", "value")


def _hybrid_sums(form: Additive, x: np.ndarray, gone: np.ndarray, feats: Sequence[str], bg: np.ndarray,
                 perms: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For every row and feature the sum of what its hybrids add, over all feature
    orders and background rows, and whether one of them had a score.

    A hybrid's weighted sum is the part of the row (the features taken so far)
    plus the part of the background row (the rest), so the sums of all hybrids of
    a step are one outer sum; each of them goes through the link."""
    w = np.array([form.weights.get(f, 0.0) for f in feats])
    used = np.array([f in form.weights for f in feats])
    own, other = np.where(used, x, 0.0) * w, np.where(used, bg, 0.0) * w
    total, known = np.zeros(x.shape), np.zeros(x.shape, dtype=bool)
    rows = max(1, CELLS_AT_ONCE // len(bg))
    for order in perms:
        taken, missing = np.full(len(x), form.bias), np.zeros(len(x), dtype=bool)
        before = None
        for j in range(len(order) + 1):
            if j:
                taken, missing = taken + own[:, order[j - 1]], missing | (gone[:, order[j - 1]] & used[order[j - 1]])
            rest = other[:, order[j:]].sum(axis=1)
            score = np.concatenate([form.scores(taken[i:i + rows, None] + rest).sum(axis=1, dtype=float)
                                    for i in range(0, len(x), rows)])
            now = np.where(missing, 0.0, score), ~missing
            if j:
                total[:, order[j - 1]] += now[0] - before[0]
                known[:, order[j - 1]] |= now[1] | before[1]
            before = now
    return total, known


def _shapley_additive(form: Additive, df: DataFrame, id_col: str, feats: Sequence[str], bg: list[list[float]],
                      perms: Sequence[Sequence[int]]) -> DataFrame:
    """The same table as the general way: the hybrids of a batch of rows are scored
    as matrices, and one row per input row leaves the task."""
    ship_package(df.sparkSession)
    p, base = len(feats), np.array(bg, dtype=float).reshape(len(bg), -1)
    rows = df.select(F.col(id_col).alias("__id"), F.array(*[F.col(f).cast("double") for f in feats]).alias("__x"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("__x"), b.num_rows)
            gone = b.column("__x").flatten().is_null().to_numpy(zero_copy_only=False).reshape(x.shape)
            if form.strict and np.isnan(x).any():
                raise ValueError("a row to explain has missing cells")
            total, known = _hybrid_sums(form, np.where(gone, 0.0, x), gone, feats, base, perms)
            sums = pa.array(total.ravel(), mask=~known.ravel())
            each = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * p)
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__x"), pa.ListArray.from_arrays(each, sums)],
                                             names=["__id", "__x", "__s"])

    done = rows.mapInArrow(run, f"__id {kind}, __x array<double>, __s array<double>")
    per_id = done.groupBy("__id").agg(F.first("__x").alias("__x"), *[
        (F.sum(F.get("__s", F.lit(i))) / F.lit(len(perms) * len(bg))).alias(f"__phi{i}") for i in range(p)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"__phi{i}").alias("phi"),
                                        F.get("__x", F.lit(i)).alias("value")) for i, f in enumerate(feats)]))
    return per_id.select(F.col("__id").alias(id_col), each.alias("__e")).select(id_col, "__e.*")


def mean_abs_importance(phi: DataFrame) -> DataFrame:
    """XPL-2: (feature, importance) = mean |phi|."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def rank_importance(imp: DataFrame, k: int | None = None) -> DataFrame:
    """XPL-3: rank by importance (descending, name breaks ties); top k if given.

    The importance table has one row per feature, so one ordered window is
    bounded by the feature count.
    """
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    r = imp.withColumn("rank", F.row_number().over(w).cast("int"))
    return r.where(F.col("rank") <= k) if k else r


# ------------------------------------------------------------------ XPL-4
def order_statistics(df: DataFrame, col: str, ks: Sequence[int]) -> dict[int, float]:
    """Exact k-th smallest non-missing values (1-based) via distinct-value
    counts and a two-level running count (no global sort)."""
    counts = value_counts(df, [col]).drop("column")
    s = ordered_scan(counts.withColumn("__g", F.lit(0)), ["__g"], "value", ["n"], descending=False)
    conds = [F.max(F.when((F.col("prev_n") < k) & (F.col("cum_n") >= k), F.col("value"))).alias(f"k{i}")
             for i, k in enumerate(ks)]
    row = s.agg(*conds).first()
    return {k: row[f"k{i}"] for i, k in enumerate(ks)}


def pdp_grid(df: DataFrame, feature: str, resolution: int = 100, lo: float = 0.05, hi: float = 0.95
             ) -> list[float]:
    """Distinct values if fewer than ``resolution``; else ``resolution``
    evenly spaced points between the lo and hi empirical quantiles
    (plotting positions alphap = betap = 0.4, as the reference library)."""
    stats = df.agg(F.count(F.col(feature)).alias("n"),
                   F.count_distinct(F.col(feature)).alias("u")).first()
    n, u = stats["n"], stats["u"]
    if u < resolution:
        vals = df.select(F.col(feature).cast("double").alias("v")).where("v IS NOT NULL").distinct()
        return sorted(r[0] for r in vals.collect())
    qs, need = [], {}
    for p in (lo, hi):
        m = 0.4 + p * (1 - 0.4 - 0.4)
        aleph = n * p + m
        k = int(min(max(aleph, 1), n - 1) // 1)
        gamma = min(max(aleph - k, 0.0), 1.0)
        qs.append((k, gamma))
        need[k] = need[k + 1] = None
    stats = order_statistics(df, feature, sorted(need))
    q = [(1 - g) * stats[k] + g * stats[k + 1] for k, g in qs]
    step = (q[1] - q[0]) / (resolution - 1)
    return [q[0] + i * step for i in range(resolution - 1)] + [q[1]]


def partial_dependence(predict_fn: Predictor, df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """XPL-4: (feature, grid_value, average) -- the mean prediction with the
    feature overwritten by each grid value (grid size bounded by the
    resolution, so rows x grid is a fixed multiple of the rows).  An additive score
    is averaged inside the tasks, one sum per grid point."""
    form = getattr(predict_fn, "additive", None)
    if form is not None and set(form.weights) - {feature} <= set(df.columns) and len(grid):
        return _dependence_additive(form, df, feature, [float(v) for v in dict.fromkeys(grid)])
    g = F.explode(F.array(*[F.lit(float(v)) for v in grid])).alias("__g")
    d = df.select("*", g).withColumn(feature, F.col("__g"))
    out = predict_fn(d)
    return out.groupBy(F.col("__g").alias("grid_value")).agg(F.avg("__f").alias("average")).select(
        F.lit(feature).alias("feature"), "grid_value", "average")


def _dependence_additive(form: Additive, df: DataFrame, feature: str, grid: Sequence[float]) -> DataFrame:
    """The same table as the general way; a row without a score (missing cells) does not count."""
    ship_package(df.sparkSession)
    rest = [f for f in form.weights if f != feature]
    w, at = np.array([form.weights[f] for f in rest]), np.array(grid) * form.weights.get(feature, 0.0)
    rows = df.select(F.array(*[F.col(f).cast("double") for f in rest]).cast("array<double>").alias("__x"))
    step = max(1, CELLS_AT_ONCE // len(grid))

    def run(batches):
        total, n, met = np.zeros(len(grid)), 0, False
        for b in batches:
            if not b.num_rows:
                continue
            met = True
            x = matrix(b.column("__x"), b.num_rows)
            gone = b.column("__x").flatten().is_null().to_numpy(zero_copy_only=False).reshape(x.shape)
            if form.strict and np.isnan(x).any():
                raise ValueError("a row to explain has missing cells")
            margins = (x[~gone.any(axis=1)] * w).sum(axis=1) + form.bias
            n += len(margins)
            for i in range(0, len(margins), step):
                total += form.scores(margins[i:i + step, None] + at).sum(axis=0, dtype=float)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(total),
                                              pa.array(np.full(len(grid), n))], names=["i", "s", "n"])

    got = rows.mapInArrow(run, "i long, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    values = F.array(*[F.lit(v) for v in grid])
    return got.select(F.lit(feature).alias("feature"), F.get(values, F.col("i").cast("int")).alias("grid_value"),
                      F.try_divide("s", "n").alias("average"))
