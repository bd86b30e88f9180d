"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Tables derived from the driver tables (cells, expression, LR rows) are written once before the
clock starts, as a user's prepared tables would be; ``prepare`` reports that time.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog import all_queries
from catalog import roles as r

HEADLINE = {
    "score_mean": "f12_flagship_mean",
    "score_tri_mean": "f12_flagship_tri_mean",
    "score_hill_cofactors": "f5_f6_hill_cofactors",
    "score_de_gate": "f10_de_gate",
    "two_sample_comparison": "i5_compare_samples",
    "permutation_pvalues": "f16_permutation_pvalues",
    "sketches": "f14_f15_sketches",
    "rank_sums": "e2_rank_sums",
    "kernel_weights": "o4_o5_kernel_weights",
    "nearest_radius": "o2_nearest_radius",
    "section_reproducibility": "o21_section_reproducibility",
    "candidates": "m6_candidates",
    "greedy_selection": "m13_predicted_lr",
    "training_negatives": "n2_degree_matched_negatives",
    "deduplicate_resources": "c4_deduplicate_training",
    "translate_texts": "l1_translate_cds",
    "curve_metrics": "n12_curve_metrics",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t0 = time.time()
    for build in (r.cells, r.expression, r.genes, r.lr_table, r.scored_lr):
        build(spark, sf_dir)
    for flag in ("R", "A"):
        r.expression(spark, sf_dir, flag)
    prepare = time.time() - t0
    queries = all_queries()
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    times = {}
    for name, key in HEADLINE.items():
        if only and name not in only:
            continue
        t0 = time.time()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "prepare": round(prepare, 3), "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
