"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a
comma-separated selection. Each query writes all of its rows to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = [
    "flagship_preprocess",      # raw hourly rows to the labelled feature table
    "f_all_features",           # all features of dense readings
    "e2_add_segments",          # islands over irregular readings
    "c3_match_rate",            # leak detection
    "d1_impute_past_median",    # exact running median
    "g7_window_vectors",        # model windows
    "g15_blend_search",         # 99 blend weights in one pass
    "h4_annual_peak_to_date",
    "h5_error_margin",          # exact running p90
    "h5_error_margin_sketch",   # the same, approximate
    "h9_alerts_manual",
    "h16_hour_profile",
    "i4_rate_lookup",
    "i8_staff_match",
    "j2_tumbling_15m",
]


def main() -> None:
    from wattloom.plans import load_all
    from wattloom.session import build_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    queries = load_all().queries
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    # start the JVM and the Python workers before the clock runs
    for warm in ("e2_add_segments", "f14_day_active"):
        queries[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline query wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
