"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 4) select
data and cores. Deriving the input tables (variants, reads, contigs) from the star
schema is timed apart as ``derive_inputs`` and is not part of the total: it stands for
data that exist before an analysis starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from methylspark.plans import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "4"))

#: In order: each later step reads the tables the earlier ones have written.
HEADLINE = ["region_result", "region_matrix", "matrix_stats", "annotate_cpg", "site_asm",
            "dist_nhd", "fill_missing_pairs", "cluster_reads_upgma", "cut_k", "silhouette",
            "cluster_stats", "fisher_exact", "truth_report", "methylation_calls",
            "modified_bases", "filter_reasons", "reference_cpg_sites"]


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]")
             .config("spark.sql.shuffle.partitions", str(2 * CPUS))
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def timed(action) -> float:
        start = time.time()
        action()
        return round(time.time() - start, 3)

    derive = timed(lambda: catalog.run_of(spark, SF_DIR))
    times = {name: timed(lambda: catalog.QUERIES[name](spark, SF_DIR)
                         .write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    run = catalog.run_of(spark, SF_DIR)
    summary = run.summary.first()
    n_cells = run.cells.count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "cpus": CPUS, "derive_inputs_sec": derive, "regions": summary.total_regions,
        "region_reads": summary.total_reads, "region_cpgs": summary.total_cpgs,
        "cells": n_cells,
        "regions_per_sec": round(summary.total_regions / times["region_result"], 1),
        "cells_per_sec": round(n_cells / times["region_result"], 1)}))


if __name__ == "__main__":
    main()
