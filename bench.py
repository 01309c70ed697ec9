"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stayline.session import local_session  # noqa: E402

HEADLINE = (
    "a6_build_cohort",
    "b5_split_sites",
    "c3_carry_forward",
    "c8_trailing_slope",
    "c10_window_features",
    "d7_measurement_frequency",
    "e1_standardised",
    "e2_logistic_baseline",
    "f10_evaluation",
    "f12_alert_burden",
    "g1_site_matrix",
    "g2_drift",
    "g6_subgroups",
    "h3_observations",
    "h11_risk_trajectory",
    "h12_worklist",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8)
    from stayline.plans.queries import QUERIES

    spark.range(1000).groupBy().count().collect()  # start the executors
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
