"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from repolumen.plans import QUERIES  # noqa: E402
from repolumen.session import drop_scratch, get_spark  # noqa: E402

HEADLINE = [
    "repo_summary", "file_counts", "fastapi_endpoints", "express_endpoints", "python_functions", "js_functions",
    "function_complexity", "python_dependencies", "env_vars", "python_symbols", "folder_summary", "module_summary",
    "hierarchy_rollup", "resolve_imports", "tech_badges", "graph_type_counts", "degree_centrality", "top_files",
    "service_port_assignment", "rolling_usage", "key_health_fold", "key_stats", "consecutive_errors", "betweenness_centrality",
    "centrality_to_nodes", "extract_context",
    "build_prompt_comprehensive", "doc_api", "doc_readme", "result_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
                                        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads outside the clock
    timings = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
