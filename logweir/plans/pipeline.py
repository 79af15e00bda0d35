"""The whole run: test the sources, scan, number, stamp, classify, route, parse, write, count."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..catalogue import DEFAULT_THRESHOLD, field_catalogue
from ..operators.classify import LogTypeModel, classify
from ..operators.envelope import envelope
from ..operators.quality import samples_frame, source_errors, usable_specs
from ..operators.route import missing_specs, normalized_of, outcomes, quarantine_of, route
from ..operators.summary import observed, run_counters
from ..session import configure
from ..sources import SOURCES, source_specs
from ..sources.scan import read_lines
from ..sources.sinks import PACKED_TABLE, metrics_record, read_metrics, write_jsonl, write_metrics, write_parquet, write_quarantine
from ..sources.spec import SourceSpec

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunResult:
    normalized: DataFrame
    quarantine: DataFrame
    summary: DataFrame


def tested_sources(spark: SparkSession, specs: dict[str, SourceSpec]) -> tuple[DataFrame, dict[str, str]]:
    """(the sources that may be used, as a table; why others may not)."""
    table = source_specs(spark, specs.values())
    samples = samples_frame(spark, {n: list(s.samples) for n, s in specs.items() if s.samples})
    errors = source_errors(samples, specs, table, field_catalogue(spark))
    # At most a row per source.
    found = {r.log_type: r.error for r in errors.collect()}
    for n, e in found.items():
        log.warning("source %s is not used: %s", n, e)
    return usable_specs(table, spark.createDataFrame(list(found.items()), "log_type string, error string")), found


def write_routed(routed: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write routed lines by log type and read them back.

    The table is the boundary between scoring and parsing: every source then
    scans only its own folder, and a lost executor costs no more than the files it was reading.
    Lines are written by the task that read and scored them.
    """
    spark = routed.sparkSession
    (routed.withColumn("part", F.col("log_type")).write.mode(mode).option("compression", PACKED_TABLE).partitionBy("part").parquet(path))
    return spark.read.schema(StructType([*routed.schema, StructField("part", StringType())])).parquet(path)


def write_outcomes(routed: DataFrame, path: str, specs: dict[str, SourceSpec], labels=(), year_hint: int | None = None,
                   now: str = "current_timestamp()", mode: str = "overwrite") -> tuple[DataFrame, dict[str, int]]:
    """Parse routed lines once, write them by outcome and type, and count them as they are written.

    Gives the stored table and its counters.
    """
    spark = routed.sparkSession
    every, watch = observed(outcomes(prune_by_part(routed), specs, year_hint, now), run_counters(specs, labels))
    every.withColumn("part", F.col("log_type")).write.mode(mode).option("compression", PACKED_TABLE).partitionBy("outcome", "part").parquet(path)
    return spark.read.schema(StructType([*every.schema, StructField("part", StringType())])).parquet(path), watch.get


def run_batch(spark: SparkSession, inputs: list[str], out: str, model: LogTypeModel,
              threshold: float = DEFAULT_THRESHOLD, year_hint: int | None = None,
              specs: dict[str, SourceSpec] | None = None, parquet: bool = False, now: str = "current_timestamp()") -> RunResult:
    """Normalize log files into ``out``: ``normalized``, ``quarantine``, ``metrics`` (and ``routed``, ``outcomes``, the stored steps).

    Sources whose samples or definition fail are not used: their lines get ``no_plugin`` and the metrics say why.
    Labels of the model without a source are named in the metrics.
    """
    configure(spark)
    started = time.time()
    specs = SOURCES if specs is None else specs
    usable, errors = tested_sources(spark, specs)
    labels = spark.createDataFrame([(c,) for c in model.classes], "label string")
    # At most a row per class of the model.
    missing = [r.label for r in missing_specs(labels, source_specs(spark, specs.values())).collect()]
    if missing:
        log.warning("no source for: %s", ", ".join(sorted(missing)))
    lines = envelope(read_lines(spark, inputs), now)
    routed = write_routed(route(classify(lines, model, threshold), usable), f"{out}/routed")
    used = {n: s for n, s in specs.items() if n not in errors}
    stored, counters = write_outcomes(routed, f"{out}/outcomes", used, [*specs, *model.classes], year_hint, now)
    ok, bad = normalized_of(stored), quarantine_of(stored, threshold)
    write_jsonl(ok, f"{out}/normalized")
    write_quarantine(bad, f"{out}/quarantine")
    if parquet:
        write_parquet(ok, f"{out}/events")
    record = metrics_record(counters, time.time() - started, inputs, threshold, used, errors, missing)
    write_metrics(spark, record, f"{out}/metrics")
    return RunResult(ok, bad, read_metrics(spark, f"{out}/metrics"))


def prune_by_part(routed: DataFrame) -> DataFrame:
    """Let filters on ``log_type`` act on the folder column it was written by."""
    if "part" not in routed.columns:
        return routed
    columns = [c for c in routed.columns if c not in ("part", "log_type")]
    return routed.select(*columns, F.col("part").alias("log_type"))
