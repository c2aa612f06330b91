"""Time the headline queries; one JSON line on stdout.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: cores. BENCH_RUNS: timed runs per query, of which
the median counts. BENCH_ALL=1: every registered query.
"""
import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnwise import plans  # noqa: E402

HEADLINE = [
    "turn_rollup", "correction_report", "dedupe_exchanges", "hits_by_span", "ask_answer", "recurring", "rediscovered",
    "missed_trigger", "long_sentences", "rule_profile", "lexical_stats", "note_rules", "fence_state", "orphan_refs", "uncovered",
    "budget_breach", "tree_report", "signed_multiset", "extra_rows", "added_lines", "required_mode", "mode_verdict",
    "nearest_root", "parent_chain", "current_decision", "stack_order", "burn_rate", "still_gaps", "ab_verdict",
    "grade_rollup", "finding_dedupe_join", "attention_list", "stuck_runs", "motion_residual", "chunk_assign",
    "stream_corrections",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = list(plans.QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # starts the engine
    times, spread = {}, {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        if runs > 1:
            spread[name] = [round(min(taken), 3), round(max(taken), 3)]
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    line = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}
    if spread:
        line["range"] = spread
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
