"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from locusframe.plans import catalog

HEADLINE = [
    "coverage_depth", "bin_depths", "bin_depths_percentiles", "exclusive_read_group_summary", "read_counter", "inverted_pair_dups", "base_quality",
    "read_length", "count_nmer", "dup_groups", "downsample_dups", "cytosine_pileup_calls", "meth_level_averages", "fraction_by_context", "cpg_summarizer",
    "window_fixed", "window_variable", "pairs_autocorr_same_read", "pairs_autocorr", "feature_alignment", "nearest_feature", "sequence_matrix",
    "matrix_downscale", "peak_derivative", "peak_groups", "downsample_coverage", "peak_segments_spread", "read_cytosines", "consensus_strings", "pairs_condition_cube",
    "bam_engine_filters", "nucleosome_centres",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalog.QUERIES["read_counter"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the session's own start
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
