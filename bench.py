"""Times the headline queries on local cores and prints one JSON line.

    BENCH_SF_DIR  directory of the Parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinmatch.plans.catalog import registered  # noqa: E402
from kinmatch.session import local_session  # noqa: E402

HEADLINE = (
    "standardize",
    "address_parts",
    "top_k_full_name",
    "top_k_last_name_address",
    "match_full_name",
    "match_last_name_address",
    "match_full_address",
    "match_full_address_any_score",
    "match_all",
    "score_pairs",
    "unmatched",
    "coverage",
    "score_distribution",
    "audit_first",
    "audit_revised",
    "threshold_sweep",
    "diff_tables",
    "near_matches",
    "unit_patterns",
    "cosine_address",
    "cosine_grid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    # One pass over a heavy query starts the Python workers and warms the JVM up.
    queries["match_all"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        if name in queries:
            begin = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
