"""Entry A on a small table with the reference's column names."""

import random
import tempfile

from wideflow.operators import flags as fl
from wideflow.operators import impute as im
from wideflow.operators import measures as ms
from wideflow.plans.cleaning import clean_table, write_variants
from wideflow.sources import io


def test_clean_table_end_to_end(spark):
    rnd = random.Random(0)
    inputs = sorted({c for _, kind, inp in ms.REFERENCE_MEASURES for c in (inp if kind != "weighted" else inp)})
    extra = ["bmi", "ilvm_cube", "vig_work_met_min", "moderate_work_met_minutes", "travel_met_minutes",
             "vig_exercise_met", "moderate_exercise_met", "cotinine", "ggt", "ldl", "glu"]
    codes = ["sex", "smoke", "alcohol", "ethnicity"]
    cols = ["s_pp_number", "abpm_overall_ht", "clinic_bp_status"] + inputs + extra + codes
    rows = []
    for i in range(60):
        r = [i, None if i == 5 else i % 2, None if i % 4 == 0 else (1 if i % 3 == 0 else 0)]
        r += [None if (j < 3 and i % 7 == 0) else rnd.uniform(50, 150) for j in range(len(inputs) + len(extra))]
        r += [i % 2, i % 2, (i // 2) % 2, i % 3]
        rows.append(tuple(r))
    schema = ", ".join(["s_pp_number int", "abpm_overall_ht int", "clinic_bp_status int"]
                       + [f"{c} double" for c in inputs + extra] + [f"{c} int" for c in codes])
    df = spark.createDataFrame(rows, schema)
    out = clean_table(df, categoric=["sex", "ethnicity"] + [n for n, _, _ in fl.REFERENCE_FLAGS],
                      estimator=im.linear_estimator(), max_iter=2)
    assert "sbp" in out.columns and "l_sbp_1" not in out.columns and "glu" not in out.columns
    assert "smoke" not in out.columns and "abpm_overall_ht" in out.columns
    # label present, cohort != 1 kept with missing status
    assert out.where("abpm_overall_ht IS NULL").count() == 0
    assert out.where("clinic_bp_status = 1").count() == 0 if "clinic_bp_status" in out.columns else True
    numeric = [c for c in out.columns if c not in ("s_pp_number", "abpm_overall_ht", "sex", "ethnicity")
               and not c.startswith("pre") and c not in [n for n, _, _ in fl.REFERENCE_FLAGS]]
    assert out.select(*numeric).dropna().count() == out.count()
    path = tempfile.mkdtemp(prefix="wideflow-variants-") + "/v"
    write_variants(out, path, ["sex", "ethnicity", "obese"])
    assert io.read_variants(spark, path).select("variant").distinct().count() == 4
