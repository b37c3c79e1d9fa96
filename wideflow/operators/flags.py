"""FLG-1..9: rule flags as ``CASE WHEN`` projections.

The reference starts every flag as missing and applies the 0-rule, then the
1-rule, so the later rule wins and no hit leaves the flag missing.  With
SQL's three-valued logic a NULL condition does not fire, which matches
pandas' "comparison with NaN is False".  ``when(one).when(zero)`` puts the
later (winning) rule first.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideflow.functions.expr import all_sum


def _flag(one: Column, zero: Column) -> Column:
    return F.when(one, 1).when(zero, 0).cast("int")


def band_flag(a: str, b: str, a_lo: float, a_hi: float, b_lo: float, b_hi: float) -> Column:
    """FLG-1: 1 if a_lo < a < a_hi or b_lo < b < b_hi; 0 if a <= a_lo and b <= b_lo."""
    A, B = F.col(a), F.col(b)
    one = ((A < a_hi) & (A > a_lo)) | ((B < b_hi) & (B > b_lo))
    zero = (A <= a_lo) & (B <= b_lo)
    return _flag(one, zero)


def cutoff_flag(c: str, cut: float, strict: bool = True) -> Column:
    """FLG-2 (strict: 1 if > cut, 0 if <= cut) and FLG-7 (1 if >= cut, 0 if < cut)."""
    x = F.col(c)
    return _flag(x > cut, x <= cut) if strict else _flag(x >= cut, x < cut)


def group_cutoff_flag(c: str, group: str, cuts: Mapping[int, float]) -> Column:
    """FLG-3: the cutoff depends on a group code; other codes give NULL."""
    x, g = F.col(c), F.col(group)
    one = F.lit(False)
    zero = F.lit(False)
    for code, cut in cuts.items():
        one = one | ((x > cut) & (g == code))
        zero = zero | ((x <= cut) & (g == code))
    return _flag(one, zero)


def sum_below_flag(cols: Sequence[str], cut: float) -> Column:
    """FLG-4: 1 if the (NULL-propagating) sum < cut, 0 if >= cut."""
    s = all_sum(cols)
    return _flag(s < cut, s >= cut)


def lab_and_report_flag(lab: str, cut: float, report: str) -> Column:
    """FLG-5/6: 1 if lab >= cut and report = 1; 0 if lab < cut or report = 0."""
    x, r = F.col(lab), F.col(report)
    return _flag((x >= cut) & (r == 1), (x < cut) | (r == 0))


def rule_prediction(c: str, cut: float) -> Column:
    """FLG-8: 1 if value > cut else 0; a missing value predicts 0."""
    return F.when(F.col(c) > cut, 1).otherwise(0).cast("int")


def binarized(score: str, thresh: float) -> Column:
    """FLG-9: strict ``score > thresh`` as 0/1 (missing -> 0)."""
    return F.when(F.col(score) > thresh, 1).otherwise(0).cast("int")


def flag_band(df: DataFrame, a: str, b: str, out: str, a_lo=119.0, a_hi=140.0,
              b_lo=79.0, b_hi=90.0) -> DataFrame:
    return df.withColumn(out, band_flag(a, b, a_lo, a_hi, b_lo, b_hi))


def flag_cutoff(df: DataFrame, c: str, cut: float, out: str, strict: bool = True) -> DataFrame:
    return df.withColumn(out, cutoff_flag(c, cut, strict))


def flag_group_cutoff(df: DataFrame, c: str, group: str, cuts: Mapping[int, float], out: str) -> DataFrame:
    return df.withColumn(out, group_cutoff_flag(c, group, cuts))


def flag_sum_below(df: DataFrame, cols: Sequence[str], cut: float, out: str) -> DataFrame:
    return df.withColumn(out, sum_below_flag(cols, cut))


def flag_lab_and_report(df: DataFrame, lab: str, cut: float, report: str, out: str) -> DataFrame:
    return df.withColumn(out, lab_and_report_flag(lab, cut, report))


def rule_baseline(df: DataFrame, c: str = "sbp", cut: float = 120.0, out: str = "rule_pred") -> DataFrame:
    return df.withColumn(out, rule_prediction(c, cut))


def binarize(df: DataFrame, score: str, thresh: float, out: str = "pred") -> DataFrame:
    return df.withColumn(out, binarized(score, thresh))


# The seven cleaning-stage flags of the reference with its fixed cut points.
# (name, kind, arguments) -- fixed values of the reference rules.
REFERENCE_FLAGS = [
    ("prehypertensive", "band", dict(a="sbp", b="dbp", a_lo=119, a_hi=140, b_lo=79, b_hi=90)),
    ("obese", "cutoff", dict(c="bmi", cut=25, strict=True)),
    ("lvh", "group_cutoff", dict(c="ilvm_cube", group="sex", cuts={1: 115, 0: 95})),
    ("sedentary", "sum_below", dict(cols=["vig_work_met_min", "moderate_work_met_minutes",
                                          "travel_met_minutes", "vig_exercise_met",
                                          "moderate_exercise_met"], cut=600)),
    ("smoker", "lab_and_report", dict(lab="cotinine", cut=11, report="smoke")),
    ("excessive_alcohol", "lab_and_report", dict(lab="ggt", cut=49, report="alcohol")),
    ("dyslipidemic", "cutoff", dict(c="ldl", cut=3.5, strict=False)),
]

_KINDS = {
    "band": lambda a: band_flag(a["a"], a["b"], a["a_lo"], a["a_hi"], a["b_lo"], a["b_hi"]),
    "cutoff": lambda a: cutoff_flag(a["c"], a["cut"], a["strict"]),
    "group_cutoff": lambda a: group_cutoff_flag(a["c"], a["group"], a["cuts"]),
    "sum_below": lambda a: sum_below_flag(a["cols"], a["cut"]),
    "lab_and_report": lambda a: lab_and_report_flag(a["lab"], a["cut"], a["report"]),
}


def flag_columns(spec=REFERENCE_FLAGS) -> list[Column]:
    """All flags of a spec as one list of aliased columns (one projection)."""
    return [_KINDS[kind](args).alias(name) for name, kind, args in spec]
