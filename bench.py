"""Benchmark of headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.  After one query that warms up
the session, each query is timed once, from building its plan to the last row of its result.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forgelens.plans.queries import build  # noqa: E402
from forgelens.session import local_session  # noqa: E402

HEADLINE = (
    "totals",
    "matrix_usage",
    "popular_actions",
    "actions_categorized",
    "ai_tool_breakdown",
    "fingerprints",
    "fingerprint_examples",
    "insight_flags",
    "repo_rollup",
    "repo_maturity",
    "practice_adoption",
    "pattern_adoption",
    "pattern_examples",
    "repo_patterns",
    "security_scores",
    "security_tool_usage",
    "quality_summary",
    "null_rates",
    "metric_diffs",
    "workflows_added",
    "pattern_changes",
    "repo_profiles",
    "link_extract",
    "short_summary",
    "seed_verdicts",
    "seed_fingerprint",
    "file_signal_adoption",
    "structure_signals",
    "incremental_changes",
    "health_check",
    "config_files",
    "extracted_workflows",
)


def evaluate(name, spark, sf_dir):
    build(name, spark, sf_dir).write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    evaluate("totals", spark, sf_dir)
    for name in HEADLINE:
        start = time.perf_counter()
        evaluate(name, spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    workflows = build("totals", spark, sf_dir).first()["total_workflows"]
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "workflows": workflows,
                "extracted_files_per_sec": round(workflows / seconds["extracted_workflows"]),
            }
        )
    )


if __name__ == "__main__":
    main()
