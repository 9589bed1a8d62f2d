"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs twice over whole tables, every output row produced; ``queries`` holds the second
(warm) time, ``cold`` the first. Steps a query stages are inside its time.
"""

from __future__ import annotations

import json
import os
import time

from seriesloom.plans.queries import REGISTRY
from tests.support import local_session

HEADLINE = [
    "scanned_tables",
    "subject_sessions",
    "fingerprints",
    "profile_overview",
    "profile_protocols",
    "series_coerced",
    "series_groups",
    "classify_series",
    "path_templates",
    "validate_paths",
    "pattern_coverage_combined",
    "prompt_batches",
    "model_mapping",
    "mapping_attached",
    "rule_matches",
    "rule_match_counts",
    "rule_program",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()

    def run(name: str) -> float:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    cold = {name: run(name) for name in HEADLINE}
    warm = {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total warm wall time",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
