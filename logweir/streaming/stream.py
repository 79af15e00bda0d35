"""Streaming runs. Each micro-batch goes through the batch operators unchanged.

What a batch has done is told by the ledger: one JSON record per batch that names the files it
committed and its counters, written last. A batch that is replayed after a failure overwrites its own
folders and its own record, so totals count it once; files of a batch without a record do not count.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalogue import DEFAULT_THRESHOLD
from ..functions.sql import text
from ..operators.classify import LogTypeModel, classify
from ..operators.envelope import drop_blank, envelope
from ..operators.route import normalized_of, quarantine_of, route
from ..plans.pipeline import write_outcomes, write_routed
from ..sources import LABELS, SOURCES, source_specs
from ..sources.scan import with_seq
from ..sources.sinks import write_jsonl, write_quarantine
from ..sources.spec import SourceSpec

LEDGER = "batch_id bigint, counters map<string, bigint>, normalized array<string>, quarantine array<string>"


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New text files under ``path`` as a stream of raw lines with their place in the file."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                    F.col("_metadata.file_block_start").alias("_block"))


def normalize_batch(batch: DataFrame, batch_id: int, out: str, model: LogTypeModel | None = None, log_type: str | None = None,
                    threshold: float = DEFAULT_THRESHOLD, year_hint: int | None = None, specs: dict[str, SourceSpec] | None = None) -> None:
    """One micro-batch of :func:`stream_lines`: routed lines and outcomes are stored, both outputs read that table.

    Nothing is held in executors between the writes, and every path carries the batch's number.
    """
    specs = SOURCES if specs is None else specs
    spark = batch.sparkSession
    lines = envelope(drop_blank(with_seq(batch)))
    if model is not None:
        typed = classify(lines, model, threshold)
    else:
        typed = lines.selectExpr("*", f"{text(log_type)} AS log_type", "1D AS confidence",
                                 f"array(named_struct('label', {text(log_type)}, 'p', 1D)) AS candidates")
    labels = [*LABELS, *(model.classes if model else [log_type])]
    routed = write_routed(route(typed, source_specs(spark, specs.values())), f"{out}/routed/batch={batch_id}")
    stored, counters = write_outcomes(routed, f"{out}/outcomes/batch={batch_id}", specs, labels, year_hint)
    paths = {kind: f"{out}/{kind}/batch={batch_id}" for kind in ("normalized", "quarantine")}
    write_jsonl(normalized_of(stored), paths["normalized"])
    write_quarantine(quarantine_of(stored, threshold), paths["quarantine"])
    # A batch's files are as many as its tasks; their names are all that reaches the driver.
    record = {"batch_id": batch_id, "counters": {k: n for k, n in counters.items() if n},
              **{kind: sorted(spark.read.text(path).inputFiles()) for kind, path in paths.items()}}
    (spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{out}/ledger/batch={batch_id}"))


def stream_normalize(spark: SparkSession, path: str, out: str, checkpoint: str,
                     model: LogTypeModel | None = None, log_type: str | None = None,
                     threshold: float = DEFAULT_THRESHOLD, year_hint: int | None = None,
                     specs: dict[str, SourceSpec] | None = None, trigger: dict | None = None,
                     max_files: int | None = None) -> StreamingQuery:
    """Normalize files as they arrive into ``out/normalized`` and ``out/quarantine``, with a ledger in ``out/ledger``.

    A file arrives whole in one batch, so line numbers are those of a batch
    run. Give ``model`` to classify, or ``log_type`` when every line is known to be of one type.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        normalize_batch(batch, batch_id, out, model, log_type, threshold, year_hint, specs)

    return (stream_lines(spark, path, max_files).writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """One row per committed batch: ``batch_id, counters, normalized, quarantine`` (counters by name, files by output)."""
    return spark.read.schema(LEDGER).json(f"{out}/ledger/*")


def stream_totals(spark: SparkSession, out: str) -> DataFrame:
    """``counter, n``: the counters of all committed batches so far (total, normalized, ok:<type>, bad:<type>, reason:<kind>)."""
    return (read_ledger(spark, out).select(F.explode("counters").alias("counter", "n"))
            .groupBy("counter").agg(F.sum("n").alias("n")))


def committed(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """The lines of one output (``normalized`` or ``quarantine``) that committed batches wrote."""
    files = [f for r in read_ledger(spark, out).select(kind).collect() for f in r[0]]
    return spark.read.text(files) if files else spark.createDataFrame([], "value string")


def stream_counters(routed: DataFrame) -> DataFrame:
    """Running number of lines per type and quarantine reason, for a streaming table of routed lines.

    Write it in ``update`` or ``complete`` mode.
    """
    return (routed.withColumn("kind", F.coalesce(F.substring_index("reason", ":", 1), F.lit("normalized")))
            .groupBy("log_type", "kind").agg(F.count("*").alias("n")))
