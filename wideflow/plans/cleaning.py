"""Entry A of the reference: raw wide table -> cleaned,
imputed table -> fill variants, as one function per step.

Every step is a DataFrame operation; the only actions are the column
profiles that decide which columns to drop (their results are bounded by
the column count), the imputer's rounds and the final write.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from wideflow.operators import clean as cl
from wideflow.operators import flags as fl
from wideflow.operators import impute as im
from wideflow.operators import measures as ms
from wideflow.operators import profile as pr
from wideflow.sources import io


# The reference's categoric codes.
REFERENCE_CATEGORIC = [
    "sex", "ethnicity", "s_meds_a", "s_meds_b", "s_meds_d", "s_meds_g", "s_meds_h", "s_meds_j", "s_meds_l",
    "s_meds_m", "s_meds_n", "s_meds_p", "s_meds_r", "s_meds_s", "s_meds_v", "s_meds_c", "s_meds_c_cardiac",
    "s_meds_c_ht", "s_meds_c_diur", "s_meds_c_bb", "s_meds_c_ccb", "s_meds_c_ren", "s_meds_c_lipid",
    "s_meds_c_other", "clinic_bp_status", "ses_skill", "ses_education", "ses_income", "ses_score", "ses_class",
    "bp_grade",
]

# The features that the reference selects by hand.
REFERENCE_MANUAL = [
    "sex", "ethnicity", "age_b", "sbp", "dbp", "map", "pp", "hr", "glucose_rerun", "trig", "ldl", "hdl", "chol",
    "cotinine", "ggt", "smoker", "excessive_alcohol", "sedentary", "prehypertensive", "obese", "lvm_cube", "lvh",
    "imtn_mean", "pwv", "mcp_1", "crp",
]

# The names that the reference shows for features.
REFERENCE_NAMES = {
    "ses_skill": "Socio-Economic Status \u2013 Skill Level",
    "ses_income": "Socio-Economic Status \u2013 Total Household Income",
    "ses_score": "Socio-Economic Status \u2013 Score",
    "ses_class": "Socio-Economic Status \u2013 Class",
    "ses_education": "Socio-Economic Status \u2013 Education",
    "bw": "Body Weight",
    "bp_grade": "Clinic Blood Pressure Grade",
    "travel_minutes_week": "Minutes/Week Traveled Using Bicycle or Walking",
    "lvpwd": "LV Posterior Wall Thickness at Diastole",
    "lvpws": "LV Posterior Wall Thickness at Systole",
    "lvs_mass": "LV Mass at Systole",
    "lad": "Left Atrium Diameter",
    "aod": "Aortic Root Diameter",
    "mv_ea_ratio": "Mitral Valve E to A Ratio",
    "ras_renin": "Ang I + Ang II",
    "dhea_s": "Dehydroepiandrosterone Sulfate",
    "cp": "C-peptide",
    "glu_u_sz_creat": "Glucose in mg/gcreat",
    "uric_u_sz_mgdl": "Uric Acid in mg/dL",
    "phos_u_sz_mgdl": "Phosphorus in mg/dL",
    "cr_u_sz": "Chromium",
    "sbp": "Systolic Blood Pressure",
    "cpp": "Central Aortic Pulse Pressure",
    "map_syst": "Mean Arterial Pressure Systole",
    "sex": "Participant Gender",
    "v": "Participant Ethnicity",
    "s_meds_a": "Medication for Alimentary Tract and Metabolism",
    "prehypertensive": "Prehypertensive",
    "sedentary": "Sedentary",
    "smoker": "Smoker",
    "excessive_alcohol": "Alcohol Consumption",
    "dyslipidemic": "Dyslipidemic",
    "obese": "Patient Obesity",
    "age_b": "Participant Age",
    "ethnicity": "Patient Ethnicity",
}


def clean_table(df: DataFrame, label: str = "abpm_overall_ht", status: str = "clinic_bp_status",
                id_col: str = "s_pp_number", categoric: Sequence[str] | None = None, max_pct: float = 10.0,
                estimator=None, max_iter: int = 10, seed: int = 42,
                measures=ms.REFERENCE_MEASURES, flags=fl.REFERENCE_FLAGS,
                removed: Sequence[str] = ms.REFERENCE_REMOVED) -> DataFrame:
    """Script-1 semantics: derived measures and flags (one projection),
    leakage columns removed, label present, cohort ``status != 1`` keeping
    missing, sparse columns then sparse rows dropped, numeric columns imputed
    (label, id and categoric codes, by default the reference's list and the
    rule flags, excluded), sparse columns and rows dropped once more, constant
    columns dropped, and the job fails if an imputed column still has a gap.
    Columns that are not numeric go.  Categoric codes are left for the fill
    variants (script 2)."""
    if categoric is None:
        categoric = [*REFERENCE_CATEGORIC, *[name for name, _, _ in flags]]
    d = ms.derive_measures(df, measures)
    d = d.select("*", *fl.flag_columns(flags))
    d = ms.drop_columns(d, removed, strict=False)
    d = cl.drop_missing(d, [label])
    if status in d.columns:
        d = cl.filter_not_equal(d, status, 1)
    d = pr.drop_sparse_columns(d, max_pct)
    d = pr.drop_sparse_rows(d, max_pct)
    keep_out = {label, id_col, *categoric}
    d = cl.numeric_only(d)
    numeric = [c for c in d.columns if c not in keep_out]
    if numeric:
        imputer = im.IterativeImputer(numeric, estimator or im.gbt_estimator(), max_iter=max_iter, seed=seed)
        d = imputer.fit_transform(d)
        d = im.fill(d, numeric, "mean")  # residual gaps (IMP-2)
    d = pr.drop_sparse_columns(d, max_pct)
    d = pr.drop_sparse_rows(d, max_pct)
    d = pr.drop_constant_columns(d)
    return pr.assert_complete(d, [c for c in numeric if c in d.columns])


def write_variants(df: DataFrame, path: str, categoric: Sequence[str]) -> DataFrame:
    """Script-2 semantics: none / mode / median / mean variants of the
    categoric codes, written as ``variant=`` partitions (SNK-2)."""
    cols = [c for c in categoric if c in df.columns]
    v = im.fill_variants(df, cols)
    io.write_table(v, path, partition_by=["variant"])
    return v
