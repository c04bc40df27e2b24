"""Headline timings; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Every query runs to its last row with a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialweave import plans  # noqa: E402
from trialweave.session import local_session  # noqa: E402

HEADLINE = (
    "ag17_class_effect",
    "tk2_top_effects",
    "ag12_signal_quality",
    "ag16_spectral_profile",
    "ag18_separability",
    "ag19_split_half",
    "gj4_evaluate_candidate",
    "gj5_candidate_sweep",
    "gj7_apply_frozen",
    "wn3_search_replay",
    "wn4_chain_faults",
    "wn5_running_totals",
    "wn14_repeated_calls",
    "jn5_grid_gaps",
    "jn6_declared_vs_observed",
    "jn10_applicability",
    "pf10_hygiene_filter",
    "pf18_quality_policy_rules",
    "sf1_clean_markup",
    "ag4_channel_signatures",
    "ag12_group_quantiles",
    "gj13_review_consistency",
    "sc8_format_inventory",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    # One warm-up so that the first query does not pay for the session.
    plans.QUERIES["ag5_status_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
