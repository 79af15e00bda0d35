"""Headline queries, timed: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data
and cores. Every query is run to the end (all columns computed, rows counted by
a no-op write); the session is warmed up once on a small query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from logweir import configure
from logweir.plans.registry import all_queries

HEADLINE = (
    "flagship extract_web_access extract_firewall_asa extract_ids_snort extract_syslog5424 extract_proxy_access "
    "extract_zeek_conn extract_zeek_dns extract_zeek_http parse_failures envelope route quarantine_project nest "
    "conservation_check traceability_audit pivot_lookup template_clusters cluster_samples mask_template "
    "doc_freq tfidf_vectors score_join class_cap stratified_split read_lines line_numbers write_normalized_jsonl "
    "stream_normalize run_pipeline"
).split()
# Rows of these tables, so many times each, are the lines of the whole run.
RUN_LINES = {"lineitem": 2, "events": 4, "orders": 2, "pages": 1}


def dealt(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The tables with ``files`` files each, as large tables come: one row group is one task, however many cores there are."""
    folder = tempfile.mkdtemp(prefix="logweir-bench-")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("logweir-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
             # The tables are single small files: cut the scan so that every core gets rows.
             .config("spark.sql.files.maxPartitionBytes", "1m").config("spark.sql.files.openCostInBytes", "64k")
             # N-grams multiply a line some hundred times, so small shuffles are not merged into one task.
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    queries["flagship"].run(spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
                            if os.path.isdir(os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")) else sf_dir).collect()
    # BENCH_LAYOUT=given times the tables as they are: one row group, so one task, each.
    layout = os.environ.get("BENCH_LAYOUT", "dealt")
    spread = dealt(spark, sf_dir, int(cpus)) if layout == "dealt" else sf_dir
    seconds = {}
    for name in wanted:
        start = time.time()
        queries[name].run(spark, spread).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rate = round(events / seconds["extract_firewall_asa"]) if "extract_firewall_asa" in seconds else None
    run = sum(n * spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t, n in RUN_LINES.items())
    print(json.dumps({"metric": "total seconds, headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
                      "firewall_lines_per_sec": rate,
                      "run_lines": run, "run_lines_per_sec": round(run / seconds["run_pipeline"]) if "run_pipeline" in seconds else None,
                      "layout": layout}))
    spark.stop()


if __name__ == "__main__":
    main()
