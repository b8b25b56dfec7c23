"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "harmonize_labels", "pair_counts_inclusion", "asof_breakpoint", "range_join_overlap", "presence_pivot",
    "column_map", "interval_union_coverage", "sketch_containment_topk", "agreement_metrics", "auroc",
    "conformal_fallback", "threshold_grid", "calibrated_interp", "confidence_levels", "qc_flags", "nearest_reference",
    "training_join", "route_mic_or_category", "canonical_genome_ids", "label_acceptance", "leakage_checklist",
    "support_margin", "pairwise_rank", "calibration_support", "op1_mix_sources", "op2_sentencepiece",
    "op3_license_scan", "op4_order_minhash", "op5_webp_media", "op6_quality", "op7_line_dedup", "op8_url_filter",
    "op9_warc", "op10_simhash", "op11_conversation_repair", "op12_annulus_clusters", "op13_ngram_rules", "pipeline",
    "known_columns_by_fold", "correlated_columns_by_fold", "score_released_model", "isotonic_fit", "probe_candidates", "anchored_candidates", "kmer_sketch_u64", "cs_table_function", "upload_acceptance",
)


def machine_seconds() -> float:
    """How long this machine takes for a fixed loop just now, so that rounds can be compared."""
    began = time.process_time()
    sum(i * i % 7 for i in range(5_000_000))
    return round(time.process_time() - began, 3)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(os.path.dirname(os.path.abspath(__file__)), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    found, took, loop = entry.queries(), {}, machine_seconds()
    for name in (n for n in HEADLINE if n in found):
        began = time.time()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "machine_loop": loop}))


if __name__ == "__main__":
    main()
