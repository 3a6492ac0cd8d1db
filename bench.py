"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "run_mart_segment_revenue", "run_mart_top_orders", "run_mart_inner_fk", "run_mart_semi_anti", "optimized_mart", "rewrite_outcomes", "weighted_jaccard_pairs",
    "backbone_groups", "closure", "freq_savings", "view_expansion", "best_flip_set", "tuned_assignment", "selected_groups", "prunable_joins",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from millrace import catalog
    from millrace.plans.demo import TABLES, demo_project
    from millrace.plans.lineage import Lineage
    from millrace.runner import run
    from millrace.tuning import tune_project

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    # The whole project under three assignments: nothing stored, everything stored, and the one tuned by times learned from a run.
    project = demo_project()
    models = {n.unique_id for n in project.models()}
    lineage = Lineage(spark, project, {t: spark.read.parquet(f"{sf}/{t}.parquet").columns for t in TABLES})
    began = time.time()
    tuned, _ = tune_project(spark, project, sf, lineage)
    times["learn_and_tune"] = round(time.time() - began, 3)
    for label, p in {
        "project_all_views": project.with_assignment({u: "view" for u in models}),
        "project_all_tables": project.with_assignment({u: "table" for u in models}),
        "project_tuned": tuned,
    }.items():
        began = time.time()
        out = run(spark, p, sf)
        for leaf in p.leaves():
            name = p.nodes[leaf].name
            if name in out.frames:
                out[name].write.format("noop").mode("overwrite").save()
        times[label] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
