"""IMP-1..7: fills and iterative model-based imputation.

Fill values for any number of columns come from two distributed passes:

* means: one aggregation;
* medians and modes: the table is unpivoted to (column, value) and counted
  per distinct value (map-side combine).  The mode is the smallest value
  among those with the top count -- two plain aggregations, no window.  The
  exact median is read off a running count over the distinct values, done
  by ``ordered_scan`` (two-level, never one task for a whole column).

``ml.Imputer`` is not used: its median is approximate ({2, 4} gives 2, not
3) and it has no first-seen tie rule.
"""

from __future__ import annotations

from typing import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideflow.functions.cross import blocks, cross_products, matrices, matrix, packed
from wideflow.functions.ranking import ordered_scan
from wideflow.operators.boost import Tree
from wideflow.session import cut_lineage, dealt_out, materialize, release, ship_package

STRATEGIES = ("mean", "median", "mode")
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_counts(df: DataFrame, cols: Sequence[str], id_col: str | None = None) -> DataFrame:
    """(column, whole, value, n[, first_id]) per distinct non-missing value of
    the numeric ``cols``.  ``value`` is the double; values of integral columns
    are counted as integers and also stand in ``whole``, so those beyond 2**53
    stay apart.  -0.0 and 0.0 are one value."""
    def cell(c):
        whole = isinstance(df.schema[c].dataType, INTEGRAL)
        return F.struct(F.lit(c).alias("column"),
                        (F.col(c) if whole else F.lit(None)).cast("long").alias("whole"),
                        (F.col(c).cast("double") + F.lit(0.0)).alias("value"))

    long = df.select(*([F.col(id_col).alias("__id")] if id_col else []),
                     F.explode(F.array(*[cell(c) for c in cols])).alias("p")).select(
        *(["__id"] if id_col else []), "p.*").where(F.col("value").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    if id_col:
        aggs.append(F.min("__id").alias("first_id"))
    return long.groupBy("column", "whole", "value").agg(*aggs)


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Those of ``cols`` that hold numbers; others have no fill value."""
    return [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]


def modes(counts: DataFrame, tie: str = "smallest") -> DataFrame:
    """(column, mode, whole): top count; ties -> smallest value, or lowest first
    id.  ``whole`` is the exact mode of an integral column."""
    top = counts.groupBy("column").agg(F.max("n").alias("__top"))
    cand = counts.join(top, on="column").where(F.col("n") == F.col("__top"))
    best = F.struct(*(["first_id"] if tie == "first" else []), "whole", "value")
    return cand.groupBy("column").agg(F.min(best).alias("b")).select(
        "column", F.col("b.value").alias("mode"), F.col("b.whole").alias("whole"))


def medians(counts: DataFrame) -> DataFrame:
    """(column, median): exact, mean of the two middle values for even n."""
    s = ordered_scan(counts, ["column"], "value", ["n"], descending=False)
    tot = counts.groupBy("column").agg(F.sum("n").alias("__tot"))
    s = s.join(tot, on="column")  # one row per column
    lo_k = F.floor((F.col("__tot") + 1) / 2)
    hi_k = F.ceil((F.col("__tot") + 1) / 2)
    hit_lo = (F.col("prev_n") < lo_k) & (F.col("cum_n") >= lo_k)
    hit_hi = (F.col("prev_n") < hi_k) & (F.col("cum_n") >= hi_k)
    return s.groupBy("column").agg(
        ((F.max(F.when(hit_lo, F.col("value"))) + F.max(F.when(hit_hi, F.col("value")))) / 2).alias("median"))


def fill_values(df: DataFrame, cols: Sequence[str], strategies: Iterable[str] = STRATEGIES,
                tie: str = "smallest", id_col: str | None = None) -> dict[str, dict[str, float | None]]:
    """{strategy: {column: value}} for all columns; bounded (3 x columns)."""
    strategies = list(strategies)
    every, cols = cols, numeric_columns(df, cols)
    out: dict[str, dict[str, float | None]] = {s: {c: None for c in every} for s in strategies}
    if not cols:
        return out
    if "mean" in strategies:
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"__a{i}") for i, c in enumerate(cols)]).first()
        out["mean"] |= {c: row[f"__a{i}"] for i, c in enumerate(cols)}
    if "mode" in strategies or "median" in strategies:
        counts = value_counts(df, cols, id_col if tie == "first" else None)
        counts = cut_lineage(counts)
        if "mode" in strategies:
            for r in modes(counts, tie).collect():
                out["mode"][r["column"]] = r["mode"] if r["whole"] is None else r["whole"]
        if "median" in strategies:
            for r in medians(counts).collect():
                out["median"][r["column"]] = r["median"]
    return out


def _filled(df: DataFrame, c: str, value) -> Column:
    """Filled column as double (a column with gaps is float in pandas too); a
    column that holds no numbers stays as it is."""
    if not numeric_columns(df, [c]):
        return F.col(c)
    if value is None:
        return F.col(c).cast("double")
    return F.coalesce(F.col(c).cast("double"), F.lit(float(value)))


def fill(df: DataFrame, cols: Sequence[str], strategy: str = "mean", tie: str = "smallest",
         id_col: str | None = None) -> DataFrame:
    """IMP-2..5: fill missing cells of ``cols`` with the column's mean, exact
    median or mode; filled columns are double, but a long column keeps its type
    under the mode.  A column without any value is left missing (IMP-7 passes it
    through), and so is one that holds no numbers."""
    vals = fill_values(df, cols, [strategy], tie, id_col)[strategy]

    def filled(c):
        if strategy == "mode" and isinstance(df.schema[c].dataType, T.LongType) and vals[c] is not None:
            return F.coalesce(F.col(c), F.lit(vals[c]).cast("long"))
        return _filled(df, c, vals[c])

    sel = [filled(c).alias(c) if c in vals else F.col(c) for c in df.columns]
    return df.select(*sel)


def fill_variants(df: DataFrame, cols: Sequence[str], strategies: Sequence[str] = ("none",) + STRATEGIES,
                  tie: str = "smallest", id_col: str | None = None, variant_col: str = "variant") -> DataFrame:
    """IMP-6: one input -> its none/mode/median/mean variants in one scan.

    The fill values are computed once; each row is then emitted once per
    variant (``explode``) with a per-variant ``CASE``, so the source is read
    a single time.
    """
    need = [s for s in strategies if s != "none"]
    vals = fill_values(df, cols, need, tie, id_col)
    v = F.col(variant_col)
    sel = []
    for c in df.columns:
        if c not in set(cols):
            sel.append(F.col(c))
            continue
        e = F.col(c).cast("double")
        expr = None
        for s in need:
            val = vals[s][c]
            if val is None:
                continue
            expr = (F.when(v == s, F.coalesce(F.col(c).cast("double"), F.lit(float(val)))) if expr is None
                    else expr.when(v == s, F.coalesce(F.col(c).cast("double"), F.lit(float(val)))))
        sel.append((expr.otherwise(e) if expr is not None else e).alias(c))
    exploded = df.select("*", F.explode(F.array(*[F.lit(s) for s in strategies])).alias(variant_col))
    return exploded.select(*sel, v)


# ------------------------------------------------------------------ IMP-1
EstimatorFactory = Callable[[str, str, int], object]


def gbt_estimator(n_trees: int = 100, step: float = 0.1, depth: int = 3) -> EstimatorFactory:
    """Boosted-tree regressor with the reference library's defaults.  Where the cells
    of all features' bins are few, the imputer grows ``GBTRegressor``'s trees from
    sums per cell (:func:`boosted_cells`); else that class is fitted."""
    def make(features: str, label: str, seed: int):
        return GBTRegressor(featuresCol=features, labelCol=label, predictionCol="__pred",
                            maxIter=n_trees, stepSize=step, maxDepth=depth, seed=seed)
    make.boosted = (n_trees, step, depth)
    return make


#: Bins of a feature (``GBTRegressor``'s default), cells of all features together that
#: the driver may hold sums of, points that stand for a task's values of a column, and
#: rows that a task adds up at a time.
TREE_BINS, TREE_CELLS, CUT_POINTS, ROWS_AT_ONCE = 32, 1 << 21, 2048, 1 << 18


class BoostedFit:
    """A boosted column model: cuts per feature (go left up to a cut) and trees on the bins."""

    def __init__(self, feats, cuts, trees):
        self.feats, self.cuts, self.trees = list(feats), cuts, trees

    def predict(self, x):
        cells = _bins(x, self.cuts)
        return sum((t.values(cells) for t in self.trees), np.zeros(len(x)))


def _bins(x, cuts):
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _points(value, weight, most: int):
    """Distinct values and their weights; of more than ``most``, as many that stand for
    equal shares of the rows (the largest value of each)."""
    value, at = np.unique(value, return_inverse=True)
    weight = np.bincount(at, weight, len(value))
    if len(value) > most:
        share = ((np.cumsum(weight) - weight / 2) / weight.sum() * most).astype(np.int64)
        last = np.flatnonzero(np.diff(share, append=most + 1))
        value, weight = value[last], np.diff(np.cumsum(weight)[last], prepend=0.0)
    return value, weight


def _cuts(value, weight):
    """All values but the largest, if there are at most ``TREE_BINS``, or so many quantiles."""
    if len(value) > TREE_BINS:
        part = np.arange(1, TREE_BINS) / TREE_BINS * weight.sum()
        value = np.unique(np.append(value[np.searchsorted(np.cumsum(weight), part, "left")], value[-1]))
    return value[:-1]


def _matrices(batches):
    """The matrices of a packed table, by at least ``ROWS_AT_ONCE`` rows but for the last."""
    some, held = [], 0
    for (x,) in blocks(batches, {"x": np.float64}, ROWS_AT_ONCE):
        some, held = [*some, x], held + len(x)
        if held >= ROWS_AT_ONCE:
            yield np.concatenate(some)
            some, held = [], 0
    if some:
        yield np.concatenate(some)


def _cuts_and_change(store: DataFrame, cols, order, means, rounds, wanted) -> tuple[dict, float]:
    """The cuts of the ``wanted`` columns after all rounds, and the largest row sum of
    absolute changes of the last one, in one pass."""
    def run(batches):
        most, seen = [0.0] * len(rounds), {c: (np.empty(0), np.empty(0)) for c in wanted}
        for x in _matrices(batches):
            x = replayed(x, cols, order, means, rounds, most)
            for c, (v, w) in seen.items():
                seen[c] = _points(np.append(v, x[:, cols.index(c)]), np.append(w, np.ones(len(x))), CUT_POINTS)
        for c, (v, w) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.string()), pa.array(v), pa.array(w)],
                                             names=["c", "v", "w"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array(most[-1:] or [0.0]),
                                          pa.array([0.0])], names=["c", "v", "w"])

    got = store.mapInArrow(run, "c string, v double, w double").toPandas()
    change = got.loc[got["c"].isna(), "v"].max()
    cuts = {}
    for c in wanted:
        own = got[got["c"] == c]
        cuts[c] = _cuts(*_points(own["v"].to_numpy(), own["w"].to_numpy(), len(own)))
    return cuts, float(change)


def _cell_sums(store: DataFrame, cols, order, means, rounds, target: str, feats: Sequence[str], cuts: list):
    """Rows and sum of the target, where it was observed, per cell of the features' bins
    after all rounds, in one pass."""
    shape = tuple(len(c) + 1 for c in cuts)
    size, y, at = int(np.prod(shape)), cols.index(target), [cols.index(f) for f in feats]

    def run(batches):
        n, s = np.zeros(size), np.zeros(size)
        for x in _matrices(batches):
            x = x[~np.isnan(x[:, y])]
            cells = _bins(replayed(x, cols, order, means, rounds)[:, at], cuts)
            code = np.ravel_multi_index(tuple(cells.T.astype(np.int64)), shape)
            n += np.bincount(code, minlength=size)
            s += np.bincount(code, x[:, y], size)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(s[met])], names=["c", "n", "s"])

    got = store.mapInArrow(run, "c long, n double, s double").groupBy("c").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    n, s = np.zeros(size), np.zeros(size)
    met = got.column("c").to_numpy()
    n[met], s[met] = got.column("n").to_numpy(), got.column("s").to_numpy()
    return n.reshape(shape), s.reshape(shape)


def _marginals(a) -> list:
    """The sums of an array along all axes but one, for each axis."""
    if a.ndim <= 1:
        return [a]
    half = a.ndim // 2
    flat = a.reshape(int(np.prod(a.shape[:half])), -1)
    return _marginals(flat.sum(1).reshape(a.shape[:half])) + _marginals(flat.sum(0).reshape(a.shape[half:]))


def boosted_cells(n, s, n_trees: int, step: float, depth: int) -> list:
    """The trees of ``GBTRegressor`` from rows ``n`` and target sums ``s`` per cell of
    the features' bins, without reading a row.

    Rows of a cell get the same predictions, so the residuals' sums follow from the
    cell's; a node is a box of cells.  As in that class the first tree fits the target,
    the others twice the residual, and a split goes to the largest fall of the squared
    error (the first feature and bin of equal ones, to 9 digits)."""
    trees, rest = [], s.copy()
    whole = tuple(slice(0, k) for k in n.shape)
    rows = _marginals(n)
    for i in range(n_trees):
        rate = 1.0 if i == 0 else 2 * step
        tree, leaves = Tree(), []
        open_ = [(0, whole, rows, _marginals(rest))]
        for level in range(depth + 1):
            opened = []
            for node, box, ns, ss in open_:
                best = _best_cut(ns, ss) if level < depth else None
                if best is None:
                    many = ns[0].sum()
                    tree.value[node] = rate * float(ss[0].sum() / many) if many else 0.0
                    leaves.append((node, box))
                    continue
                f, k = best
                cut = box[f].start + k
                a, b = tree.split(node, f, cut)
                left = (*box[:f], slice(box[f].start, cut + 1), *box[f + 1:])
                right = (*box[:f], slice(cut + 1, box[f].stop), *box[f + 1:])
                # the sums of the smaller box are added up, those of the other are what is left
                small = left if cut + 1 - box[f].start <= box[f].stop - cut - 1 else right
                n0, s0 = _marginals(n[small]), _marginals(rest[small])
                n1, s1 = _rest_of(ns, n0, f, small is left), _rest_of(ss, s0, f, small is left)
                pair = [(n0, s0), (n1, s1)] if small is left else [(n1, s1), (n0, s0)]
                opened += [(a, left, *pair[0]), (b, right, *pair[1])]
            open_ = opened
        for node, box in leaves:
            rest[box] -= tree.value[node] * n[box]
        trees.append(tree)
    return trees


def _rest_of(all_: list, part: list, axis: int, first: bool) -> list:
    """The marginals of a box without a part that was cut off it along an axis."""
    k = len(part[axis])
    return [(a[k:] if first else a[:len(a) - k]) if i == axis else a - p
            for i, (a, p) in enumerate(zip(all_, part, strict=True))]


def _best_cut(rows: list, sums: list) -> tuple[int, int] | None:
    """(axis, last place of the left side) of the split with the largest gain."""
    best, top = None, 0.0
    for f, (ns, ss) in enumerate(zip(rows, sums, strict=True)):
        nl, sl = np.cumsum(ns), np.cumsum(ss)
        many, total = nl[-1], sl[-1]
        nl, sl = nl[:-1], sl[:-1]
        ok = (nl >= 1) & (many - nl >= 1)
        if not ok.any():
            continue
        gain = np.full(len(nl), -np.inf)
        gain[ok] = (sl[ok] ** 2 / nl[ok] + (total - sl[ok]) ** 2 / (many - nl[ok])) - total ** 2 / many
        most = gain.max()
        if most > top * (1 + 1e-9) and most > 1e-12 * max(total ** 2 / many, 1e-300):
            best, top = (f, int(np.flatnonzero(gain >= most * (1 - 1e-9))[0])), most
    return best


def linear_estimator(reg: float = 0.0) -> EstimatorFactory:
    """Least squares with intercept.  The imputer solves it from sums of products
    per missingness pattern, or from one pass per column step where patterns are
    too many (``LinearRegression`` with the same settings gives the same fit, at
    several passes each)."""
    def make(features: str, label: str, seed: int):
        return LinearRegression(featuresCol=features, labelCol=label, predictionCol="__pred",
                                regParam=reg, standardization=False)
    make.closed_form = True
    make.reg = reg
    return make


class LinearFit:
    """A least-squares column model kept as plain weights (an expression)."""

    def __init__(self, feats, weights, intercept):
        self.feats, self.weights, self.intercept = list(feats), list(weights), float(intercept)

    def predict(self, x):
        return x @ np.array(self.weights) + self.intercept

    def expr(self) -> Column:
        e = F.lit(self.intercept)
        for f, w in zip(self.feats, self.weights):
            e = e + F.col(f) * F.lit(float(w))
        return e


def _solved(sums, target: int, feats: Sequence[int], reg: float = 0.0):
    """(weights, intercept) of the least-squares fit of one column by others, from
    the sums of products of [1, columns...]; the fit of least norm, if many fit."""
    at = [0, *[f + 1 for f in feats]]
    A = sums[np.ix_(at, at)].copy()
    if reg:
        A[1:, 1:] += reg * sums[0, 0] * np.eye(len(feats))
    sol = np.linalg.lstsq(A, sums[at, target + 1], rcond=None)[0]
    return sol[1:], float(sol[0])


def _least_squares(df: DataFrame, target: str, feats: Sequence[str], reg: float = 0.0) -> LinearFit:
    """One pass over the rows: sums of products, then a solve on the driver that is
    bounded by the column count."""
    cols = [*feats, target]
    sums = matrices(cross_products(df, F.lit(0), [F.lit(1.0), *[F.col(c) for c in cols]]), len(cols) + 1)
    w, b = _solved(sums[0], len(feats), range(len(feats)), reg)
    return LinearFit(feats, w, b)


#: Numbers (patterns x columns squared) that the driver may hold for linear
#: imputation by missingness pattern; beyond it, every column step reads the rows.
PATTERN_NUMBERS = 20_000_000


def _pattern(order: Sequence[str]) -> Column:
    """Which of the columns are missing, as a text of 0 and 1."""
    return F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in order])


def pattern_rounds(products: dict, cols: Sequence[str], order: Sequence[str], means: dict, reg: float,
                   rounds: int) -> list:
    """The column models of all rounds, from the sums of products of [1, columns...]
    per missingness pattern (missing cells 0), without reading a row.

    An imputed cell is a linear function of the row's observed ones, so a pattern
    has one matrix that completes its rows, and the sums of products of completed
    rows are that matrix applied to both sides of the pattern's sums.
    """
    p, at = len(cols), {c: i for i, c in enumerate(cols)}
    whole = {}
    for code in products:
        t = np.eye(p + 1)
        for c, flag in zip(order, code):
            if flag == "1":
                t[at[c] + 1] = 0.0
                t[at[c] + 1, 0] = means[c]
        whole[code] = t
    completed = {code: whole[code] @ m @ whole[code].T for code, m in products.items()}
    out = []
    for _ in range(rounds):
        models = []
        for k, c in enumerate(order):
            feats = [f for f in cols if f != c]
            seen = sum((s for code, s in completed.items() if code[k] == "0"), np.zeros((p + 1, p + 1)))
            w, b = _solved(seen, at[c], [at[f] for f in feats], reg)
            models.append((c, LinearFit(feats, w, b), feats))
            row = np.zeros(p + 1)
            row[0] = b
            row[[at[f] + 1 for f in feats]] = w
            for code in products:
                if code[k] == "1":
                    whole[code][at[c] + 1] = row @ whole[code]
                    completed[code] = whole[code] @ products[code] @ whole[code].T
        out.append(models)
    return out


def replayed(x, cols: Sequence[str], order: Sequence[str], means: dict, rounds: list, changes: list | None = None):
    """The rows (missing cells NaN) after the column models of all rounds; the
    largest row sum of absolute changes of each round goes to ``changes``."""
    at = {c: i for i, c in enumerate(cols)}
    gone = {c: np.isnan(x[:, at[c]]) for c in order}
    x = x.copy()
    for c in order:
        x[gone[c], at[c]] = means[c]
    for r, models in enumerate(rounds):
        before = x.copy() if changes is not None else None
        for c, fit, feats in models:
            rows = gone[c]
            x[rows, at[c]] = fit.predict(x[np.ix_(rows, [at[f] for f in feats])])
        if changes is not None:
            changes[r] = max(changes[r], float(np.abs(x - before).sum(axis=1).max(initial=0.0)))
    return x


def _numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))


def round_changes(df: DataFrame, cols, order, means, rounds) -> list[float]:
    """Largest change of each round, in one pass over the rows."""
    ship_package(df.sparkSession)

    def run(batches):
        most = [0.0] * len(rounds)
        for b in batches:
            if b.num_rows:
                replayed(matrix(b.column("x"), b.num_rows), cols, order, means, rounds, most)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(most)), pa.int32()), pa.array(most)], names=["r", "d"])

    got = _numbers(df, cols).mapInArrow(run, "r int, d double").groupBy("r").agg(F.max("d").alias("d")).collect()
    out = [0.0] * len(rounds)
    for r in got:
        out[r["r"]] = r["d"]
    return out


def replay(df: DataFrame, cols, order, means, rounds) -> DataFrame:
    """``df`` with the columns of ``cols`` completed, in one pass."""
    ship_package(df.sparkSession)

    cols = list(cols)
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in cols else f for f in df.schema.fields])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = replayed(matrix(b.column("__x"), b.num_rows), cols, order, means, rounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[:, cols.index(f.name)]) if f.name in cols else b.column(f.name) for f in schema.fields],
                    names=[f.name for f in schema.fields])

    cells = F.array(*[F.col(c).cast("double") for c in cols]).alias("__x")
    return df.select(*[F.col(c) for c in df.columns if c not in cols], cells).mapInArrow(run, schema)


class IterativeImputerModel:
    """Replays the fitted round-robin sequence on any table."""

    def __init__(self, cols, order, means, rounds, n_iter):
        self.cols, self.order, self.means, self.rounds, self.n_iter = cols, order, means, rounds, n_iter

    def transform(self, df: DataFrame) -> DataFrame:
        usable = [c for c in self.cols if c in self.means]
        if all(isinstance(m, (LinearFit, BoostedFit)) for models in self.rounds for _, m, _ in models) and usable:
            return replay(df, usable, [c for c in self.order], self.means, self.rounds)
        masks = {c: f"__m_{c}" for c in self.order}
        work = df.select("*", *[F.col(c).isNull().alias(masks[c]) for c in self.order])
        work = work.select(*[F.coalesce(F.col(c).cast("double"), F.lit(self.means[c])).alias(c)
                             if c in self.means else F.col(c) for c in work.columns])
        for models in self.rounds:
            for c, model, feats in models:
                work = _apply_model(work, c, masks[c], model, feats)
            work = cut_lineage(work)
        return work.drop(*masks.values())


def _apply_model(work: DataFrame, c: str, mask: str, model, feats: Sequence[str]) -> DataFrame:
    if isinstance(model, LinearFit):
        return work.withColumn(c, F.when(F.col(mask), model.expr()).otherwise(F.col(c)))
    vec = VectorAssembler(inputCols=list(feats), outputCol="__x", handleInvalid="keep").transform(work)
    pred = model.transform(vec)
    return pred.withColumn(c, F.when(F.col(mask), F.col("__pred")).otherwise(F.col(c))).drop("__x", "__pred")


class IterativeImputer:
    """IMP-1 / IMP-1b: round-robin regression imputation of numeric columns.

    Starts from column means; visits incomplete columns from fewest to most
    missing; each column is regressed on all other imputed columns using
    the rows where it was observed, and its missing cells are replaced by
    the prediction.  Stops after ``max_iter`` rounds or when the largest
    row-wise sum of absolute changes falls below ``tol`` times the largest
    absolute observed value.  Linear rounds are solved from sums per missingness
    pattern, with two passes over the rows in all; boosted ones from sums per cell of
    the features' bins.  Other rounds are checkpointed
    to the shared checkpoint folder, so lineage stays short and lost executors
    cost one round at most; so are linear ones where the patterns are too many
    for the driver (``PATTERN_NUMBERS``).  The label and the row id must not be in ``cols``.
    """

    def __init__(self, cols: Sequence[str], estimator: EstimatorFactory | None = None,
                 max_iter: int = 10, tol: float = 1e-3, seed: int = 42):
        self.cols = list(cols)
        self.estimator = estimator or gbt_estimator()
        self.max_iter, self.tol, self.seed = max_iter, tol, seed

    def fit(self, df: DataFrame) -> IterativeImputerModel:
        cols = self.cols
        given = df
        if getattr(df, "wideflow_path", None) is None:
            df = cut_lineage(df)                     # read several times below
        stats = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                       *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)],
                       F.greatest(*[F.max(F.abs(F.col(c).cast("double"))) for c in cols]).alias("absmax")
                       ).first()
        means = {c: stats[f"a{i}"] for i, c in enumerate(cols) if stats[f"a{i}"] is not None}
        missing = {c: stats[f"m{i}"] for i, c in enumerate(cols)}
        # Columns with no observed value cannot be modelled (IMP-7): passed through as they are.
        order = sorted([c for c in cols if missing[c] > 0 and c in means], key=lambda c: (missing[c], cols.index(c)))
        tol = self.tol * (stats["absmax"] or 0.0)
        if order and getattr(self.estimator, "closed_form", False):
            model = self._by_pattern(df, [c for c in cols if c in means], order, means, tol)
            if model is not None:
                return model
        if order and hasattr(self.estimator, "boosted"):
            model = self._by_cells(df, [c for c in cols if c in means], order, means, tol)
            if model is not None:
                return model
        masks = {c: f"__m_{c}" for c in order}
        work = df.select(*[F.col(c).cast("double").alias(c) if c in means else F.col(c) for c in df.columns],
                         *[F.col(c).isNull().alias(masks[c]) for c in order])
        work = work.select(*[F.coalesce(F.col(c), F.lit(means[c])).alias(c) if c in means else F.col(c)
                             for c in df.columns], *masks.values())
        work = cut_lineage(work)
        if df is not given:
            release(df)
        rounds = []
        usable = [c for c in cols if c in means]
        for it in range(self.max_iter):
            if not order:
                break
            before = work
            work = work.select("*", *[F.col(c).alias(f"__old_{c}") for c in order])
            models = []
            for c in order:
                feats = [f for f in usable if f != c]
                seen = work.where(~F.col(masks[c]))
                if getattr(self.estimator, "closed_form", False):
                    model = _least_squares(seen, c, feats, self.estimator.reg)
                else:
                    vec = VectorAssembler(inputCols=feats, outputCol="__x", handleInvalid="keep").transform(work)
                    est = self.estimator("__x", c, self.seed + it)
                    model = est.fit(vec.where(~F.col(masks[c])))
                models.append((c, model, feats))
                work = _apply_model(work, c, masks[c], model, feats)
            work = cut_lineage(work)
            release(before)
            rounds.append(models)
            # Matrix inf-norm of the change: largest row-wise sum of |delta|,
            # one aggregation over the stored round.
            change = sum(F.abs(F.col(c) - F.col(f"__old_{c}")) for c in order)
            delta = work.agg(F.max(change).alias("d")).first()["d"]
            path = work.wideflow_path
            work = work.drop(*[f"__old_{c}" for c in order])
            work.wideflow_path = path
            if delta is not None and delta < tol:
                break
        model = IterativeImputerModel(cols, order, means, rounds, len(rounds))
        model.fitted_ = work.drop(*masks.values())
        return model

    def _by_cells(self, df, usable, order, means, tol) -> IterativeImputerModel | None:
        """Boosted rounds from sums per cell of the features' bins, by one pass over the
        rows per column step and one per round for the cuts and the stopping test; None
        if the cells are too many for the driver.  A pass completes the rows by the
        models so far, so nothing is stored for a round."""
        ship_package(df.sparkSession)
        store = materialize(packed(dealt_out(_numbers(df, usable))))
        rounds, cuts = [], {}
        while len(rounds) < self.max_iter:
            new, change = _cuts_and_change(store, usable, order, means, rounds, order if rounds else usable)
            if rounds and change < tol:
                break
            cuts |= new
            models = []
            for c in order:
                feats = [f for f in usable if f != c]
                own = [cuts[f] for f in feats]
                if not feats or np.prod([len(k) + 1.0 for k in own]) > TREE_CELLS:
                    release(store)
                    return None
                n, s = _cell_sums(store, usable, order, means, [*rounds, models], c, feats, own)
                models.append((c, BoostedFit(feats, own, boosted_cells(n, s, *self.estimator.boosted)), feats))
            rounds.append(models)
        release(store)
        model = IterativeImputerModel(self.cols, order, means, rounds, len(rounds))
        model.fitted_ = model.transform(df)
        return model

    def _by_pattern(self, df, usable, order, means, tol) -> IterativeImputerModel | None:
        """Linear rounds from one pass of sums per missingness pattern, and one more
        for the stopping test; None if the patterns are too many for the driver."""
        code = _pattern(order)
        patterns = df.select(code.alias("p")).distinct().count()
        if patterns * (len(usable) + 1) ** 2 > PATTERN_NUMBERS:
            return None
        columns = [F.lit(1.0), *[F.col(c) for c in usable]]
        products = matrices(cross_products(df, code, columns), len(columns))
        rounds = pattern_rounds(products, usable, order, means, self.estimator.reg, self.max_iter)
        changes = round_changes(df, usable, order, means, rounds)
        last = next((i + 1 for i, d in enumerate(changes) if d < tol), len(rounds))
        model = IterativeImputerModel(self.cols, order, means, rounds[:last], last)
        model.fitted_ = model.transform(df)
        return model

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """The imputed table computed while fitting (no second pass)."""
        return self.fit(df).fitted_
