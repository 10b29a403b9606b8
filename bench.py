"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is
run to a noop sink once to warm up and then timed; `value` is the sum of the times.
"""

from __future__ import annotations

import json
import os
import time

from tunelake.plans import registry, workload_sql
from tunelake.plans.tables import register_views
from tunelake.session import build_session

HEADLINE = [
    "q04_self_join", "q05_band_join", "q16_group_by_alias", "q19_count_distinct", "q21_sum_expression",
    "q27_correlated_subquery", "q31_correlated_exists", "q32_derived_table", "q36_window_average", "q38_topk_revenue",
    "a1_best_config", "a2_crash_cap", "a6_workload_features", "a9_accuracy", "a10_confusion", "a11_label_report",
    "a14_best_response", "a15_replay_throughput", "w3_incumbent_trace", "w6_exact_split", "j4_truth_prediction",
    "v1_plan_nodes", "v3_plan_text", "s3_run_history", "s7_replay_statements", "s14_run_log", "st1_best_stream",
    "m5_group_mean_cv", "m9_best_candidates",
    "t1_build_samples", "t2_best_records", "t3_sample_records", "t4_merge_and_split", "t6_analytic_prompt",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)

    register_views(spark, sf_dir)
    started = time.perf_counter()
    for sql in workload_sql.STATEMENTS.values():
        spark.sql(sql).write.format("noop").mode("overwrite").save()
    replay = time.perf_counter() - started
    seconds["replay_all_statements"] = round(replay, 3)
    print(json.dumps({
        "metric": "headline_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "statements_per_sec": round(len(workload_sql.STATEMENTS) / replay, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
