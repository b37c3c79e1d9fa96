"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is run once cold (warm-up, not counted) and then timed as the
median of $BENCH_RUNS warm runs (default 3); the value is the sum of medians.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wideflow.plans import catalog  # noqa: E402
from wideflow.session import local_session  # noqa: E402

HEADLINE = [
    "sweep_performance",      # SWP-1: 121 splits x metric record
    "threshold_sweep",        # THR-1: 980 thresholds x 10 folds
    "profile_columns",        # AGG-1..3: column profile in one pass
    "drop_sparse_rows",       # FLT-3 + FLT-4
    "fill_variants",          # IMP-6: none/mode/median/mean
    "roc_auc",                # EVL-5
    "impute_iterative_linear",  # IMP-1b
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [a for a in sys.argv[1:]]
    spark = local_session(cpus)
    qs = catalog.queries()
    names = [n for n in (only or HEADLINE) if n in qs]
    out = {}
    for name in names:
        fn = qs[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
        print(f"# {name}: {out[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
