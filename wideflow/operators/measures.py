"""PRJ-1..6: combine repeated measures in one projection.

A derived mean is ``(a + b + ...) / n``: any missing input makes it missing
(pandas NaN arithmetic; Spark NULL arithmetic behaves the same).  All
outputs of a spec are built in **one** ``select`` (no chain of
``withColumn`` / ``drop`` calls), so the analyzer sees one projection.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideflow.functions.expr import all_sum, require_columns


def mean_expr(inputs: Sequence[str]) -> Column:
    return all_sum(inputs) / F.lit(float(len(inputs)))


def _apply(df: DataFrame, new: list[tuple[str, Column]], consumed: Iterable[str]) -> DataFrame:
    """Keep untouched columns in order, drop consumed ones, append outputs."""
    gone = set(consumed) | {name for name, _ in new}
    keep = [F.col(c) for c in df.columns if c not in gone]
    return df.select(*keep, *[expr.alias(name) for name, expr in new])


def mean_of(df: DataFrame, inputs: Sequence[str], out: str, drop: bool = True) -> DataFrame:
    """PRJ-1: n-way mean of repeated measures; inputs dropped (strict)."""
    require_columns(df, inputs)
    return _apply(df, [(out, mean_expr(inputs))], inputs if drop else ())


def mean_pairs(df: DataFrame, pairs: Mapping[str, tuple[str, str]], drop: bool = True) -> DataFrame:
    """PRJ-2: ``out = (a + b) / 2`` for every entry; inputs dropped (strict)."""
    used = [c for ab in pairs.values() for c in ab]
    require_columns(df, used)
    return _apply(df, [(out, mean_expr(ab)) for out, ab in pairs.items()], used if drop else ())


def rename_measures(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """PRJ-3: rename (the old name disappears)."""
    require_columns(df, names)
    return df.withColumnsRenamed(dict(names))


def weighted_sum(df: DataFrame, weights: Mapping[str, float], out: str, drop: bool = True) -> DataFrame:
    """PRJ-4: ``sum(w_c * c)``; ``AS_CODED`` weights repeat the reference's
    pulse-pressure line, ``MEAN3`` the mean its comment describes."""
    require_columns(df, weights)
    expr = all_sum([F.col(c) * F.lit(float(w)) for c, w in weights.items()])
    return _apply(df, [(out, expr)], list(weights) if drop else ())


def drop_columns(df: DataFrame, names: Iterable[str], strict: bool = True) -> DataFrame:
    """PRJ-5 (strict: unknown names raise) and PRJ-6 (``strict=False``: drop if present)."""
    names = list(dict.fromkeys(names))
    if strict:
        require_columns(df, names)
    present = [n for n in names if n in set(df.columns)]
    return df.drop(*present)


def derive_measures(df: DataFrame, spec=None) -> DataFrame:
    """All derived measures of a spec in one projection.

    ``spec`` rows are (output, kind, inputs) with kind ``mean`` (n-way or
    pair), ``rename`` or ``weighted`` (inputs = {column: weight}).  Inputs
    are consumed; unknown inputs raise.
    """
    spec = REFERENCE_MEASURES if spec is None else spec
    new, used = [], []
    for out, kind, inputs in spec:
        if kind == "mean":
            new.append((out, mean_expr(inputs)))
            used += list(inputs)
        elif kind == "rename":
            new.append((out, F.col(inputs[0])))
            used += list(inputs)
        elif kind == "weighted":
            new.append((out, all_sum([F.col(c) * F.lit(float(w)) for c, w in inputs.items()])))
            used += list(inputs)
        else:
            raise ValueError(f"unknown measure kind {kind!r}")
    require_columns(df, used)
    return _apply(df, new, used)


# Weights of the pulse-pressure combination: as coded (only the last term
# divided by three) and the three-way mean the reference comment describes.
AS_CODED = (1.0, 1.0, 1.0 / 3.0)
MEAN3 = (1.0 / 3.0, 1.0 / 3.0, 1.0 / 3.0)


def _lr(stem: str) -> tuple[str, str, list[str]]:
    return (stem, "mean", [f"l_{stem}", f"r_{stem}"])


# The reference's derived measures (output, kind, inputs).
REFERENCE_MEASURES = [
    ("sbp", "mean", ["l_sbp_1", "l_sbp_2", "r_sbp_1", "r_sbp_2", "sphygmocor_sbp1", "sphygmocor_sbp2",
                     "csbp_1", "csbp_2", "l_osbp", "r_osbp"]),
    ("dbp", "mean", ["l_dbp_1", "l_dbp_2", "r_dbp_1", "r_dbp_2", "sphygmocor_dbp1", "sphygmocor_dbp2",
                     "cdbp_1", "cdbp_2", "l_odbp", "r_odbp"]),
    ("hr", "mean", ["l_hr_1", "l_hr_2", "r_hr_1", "r_hr_2", "sphyg_hr1", "sphyg_hr2"]),
    ("cpp", "mean", ["cpp1", "cpp2"]),
    ("map", "rename", ["clinic_map"]),
    ("map_syst", "mean", ["map_syst_1", "map_syst_2"]),
    ("map_dia", "mean", ["map_dia_1", "map_dia_2"]),
    ("cmp", "mean", ["cmp_1", "cmp_2"]),
    ("pp", "weighted", dict(zip(["pulse_pressure", "l_pp", "r_pp"], AS_CODED))),
    ("ap", "mean", ["ap_1", "ap_2"]),
    ("cai", "mean", ["cai_1", "cai_2"]),
    _lr("imtn_mean"), _lr("imtn_min"), _lr("imtn_max"), _lr("imtn_std"), _lr("imtn_length"),
    _lr("imtf_mean"), _lr("imtf_min"), _lr("imtf_max"), _lr("imtf_std"), _lr("imtf_length"),
    _lr("ld_mean"), _lr("ld_min"), _lr("ld_max"), _lr("ld_std"), _lr("ld_legth"),
    _lr("ad_mean"), _lr("ad_min"), _lr("ad_max"), _lr("ad_std"), _lr("ad_length"),
    _lr("rough_near"), _lr("rough_far"),
    _lr("cca_ps"), _lr("cca_ed"), _lr("ica_ps"), _lr("ica_ed"),
    ("cswa", "mean", ["lcswa", "rcswa"]),
    ("pwv", "mean", ["pwv1", "pwv2"]),
    _lr("acimt"), _lr("delta_ld"), _lr("strain"), _lr("distensibility"),
    _lr("compliance"), _lr("bsi"), _lr("pem"), _lr("yem"),
]

# Columns the reference removes before modelling (leakage and
# consumed inputs), in its order, duplicates included.
REFERENCE_REMOVED = [
    "apparatus", "infl_24", "nr_infl", "day_infl", "perc_succ_infl", "seventy_perc_yn", "night_infl",
    "day_inflation_complete", "night_inflation_complete", "abpm_24_s", "abpm_24_d", "abpm_24_pp",
    "map_24h", "abpm_24_ht", "abpm_d_sbp", "abpm_d_dbp", "abpm_d_pp", "map_day", "abpm_d_ht",
    "abpm_n_sbp", "abpm_n_dbp", "abpm_n_pp", "map_night", "abpm_n_ht", "percent_dip", "dipper",
    "masked_ht", "pulse_24", "pulse_d", "pulse_n", "aha_ht", "aha_sht", "aha_mht", "aha_wcht",
    "aha_abpm_ht", "smoke", "alcohol", "pulse_night", "percent_dip", "travel_met_minutes", "glu",
]
