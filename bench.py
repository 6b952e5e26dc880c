"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s02_drop_binary", "s05_admit_upload", "s10_content_lookup", "e13_python_exact",
    "e22_elements", "m05_summary", "m09_concepts", "m11_suggestions", "f09_scan_rules",
    "a02_project_totals", "a03_common_imports", "a08_project_concepts", "a12_components",
    "a17_project_review", "j01_file_edges", "j02_component_edges", "j03_class_edges",
    "j04_similar_documents", "j04_similar_code", "j05_copied_sources", "j06_percent_copied",
    "q02_find_elements", "q04_where_used", "q05_what_is", "q14_concepts", "q16_compare",
    "answer_all", "q04_where_used_refs", "q10_explain_line", "q13_compare_files", "s07_results_json",
    "q11_compare_functions", "q12_compare_classes", "s07_stored_runs",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from codequarry.plans.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "unit": "sec",
                      "value": round(sum(timings.values()), 3), "queries": timings,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
