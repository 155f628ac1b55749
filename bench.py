"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from rateforge.catalog import all_queries
from rateforge.session import build_session

HEADLINE = [
    "F6_filter_chain_steps", "F6_clean_table", "A3_length_quantiles", "A9_duplicate_profile",
    "A11_group_concentration", "A12_chain_suppliers", "A15_between_group_variance",
    "N1_prioritised_mention", "N2_earliest_mention", "N6_distinctive_terms", "E1_metric_set",
    "E7_slice_table", "E8_calibration_error", "E12_error_table", "E10_E13_cluster_bootstrap",
    "C4_fit_temperature", "C5_calibration_metrics", "X1_group_split", "X3_random_split",
    "T5_sample_per_stratum", "U3_text_overlap", "N3_J6_near_duplicates", "M1_word_tfidf_weights",
    "M3_logistic_regression", "M8_P18_batch_scoring", "M9_parity_check",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__rateforge__textPartitions=cpus,
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="rateforge-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    names = sys.argv[1:] or HEADLINE
    # The line below must come out whatever a single query does: none starts after the budget.
    deadline, skipped = time.perf_counter() + float(os.environ.get("BENCH_SECONDS", "1500")), {}
    queries["A2_value_counts"](spark, sf_dir).collect()  # start the session's machinery
    for name in names:
        start = time.perf_counter()
        if start > deadline:
            skipped[name] = "no time left"
            continue
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001  the other figures are still wanted
            skipped[name] = repr(error)[:200]
            print(f"{name} failed: {error!r}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, **({"skipped": skipped} if skipped else {}), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
