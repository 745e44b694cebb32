"""Times the headline queries and prints one JSON line.

Every query writes to the noop sink, so that all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import registered  # noqa: E402
from tidemark.session import build_session  # noqa: E402
from tidemark.staging import clear_staged  # noqa: E402

HEADLINE = [
    "top_hotspots", "complexity_percentiles", "churn_per_file", "churn_window_pick", "commit_count_decile",
    "change_coupling_pairs", "containment_ratio", "authorship_class", "contributor_rollup", "accretion_ratchet",
    "running_net_delta", "directory_rollup", "hotspot_transitions", "nearest_ancestor_join", "doc_staleness_ratio",
    "doc_edge_build", "glob_path_join", "grouping_disagreement", "age_markers", "scan_sensitive_content",
    "instruction_score", "scan_directive_clarity", "duplicate_statements", "import_edge_build", "comprehension_footprint",
    "modularity_q", "pagerank", "weak_components", "strong_components", "communities", "breakup_candidates", "dependency_levels", "hot_file_groups", "reachability", "default_branch_ci", "run_certification", "scan_numstat_log", "pr_merge_readiness",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered.all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        clear_staged(spark)
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
