"""Benchmark: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "headline_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

An untimed warm-up on sf0.001 runs first.  Each query is forced with the ``noop`` sink (full execution, nothing
collected).  ``load_tables`` -- deriving and writing the logical input
tables for both fixtures, the analogue of the reference's CSV-to-Parquet
step -- is timed on its own first, so the other entries measure the
operators over stored tables, as the reference's scripts do.
``value`` is the sum over all timed entries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "reduce_transactions", "cat_dept_map", "history_offers", "lookback_join",
    "has_bought_30", "has_bought_60", "has_bought_90", "has_bought_180",
    "user_spend", "product_share", "competition", "assemble_features",
    "check_cohort_rows", "auc_roc", "gbt_scores", "submission",
]
OPTIONAL = ["cv_grid_metrics", "model_compare", "src_csv_roundtrip", "sink_parquet_roundtrip"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    extra = [q for q in os.environ.get("BENCH_EXTRA", "").split(",") if q]
    from revisit.plans.queries import queries
    from revisit.session import get_session
    from revisit.sources.fixtures import load_tables

    spark = get_session(f"local[{cpus}]", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = queries()
    times: dict[str, float] = {}

    # Untimed JVM / code-generation warm-up on the smallest tables, so the
    # first timed entry does not carry the one-off start-up cost.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm) and warm != sf_dir:
        for name in HEADLINE:
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()

    t0 = time.perf_counter()
    for fixture in ("sparse", "dense"):
        load_tables(spark, sf_dir, fixture)
    times["load_tables"] = time.perf_counter() - t0

    for name in HEADLINE + [q for q in extra if q in OPTIONAL]:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    times["load_tables"] = round(times["load_tables"], 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
