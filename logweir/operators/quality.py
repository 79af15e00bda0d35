"""Audits: nothing lost, nothing invented, every field in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import vocabulary
from ..functions.sql import name, text
from ..sources.spec import SourceSpec, staged


def conservation(events: DataFrame, ok: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row of counts: events in, out by either way, and ids lost, invented or in both.

    Each input is a table with ``event_id``. One aggregation over the tagged
    union finds all three kinds of fault.
    """
    tagged = (events.selectExpr("event_id", "1 AS i", "0 AS o", "0 AS q")
              .unionByName(ok.selectExpr("event_id", "0 AS i", "1 AS o", "0 AS q"))
              .unionByName(quarantine.selectExpr("event_id", "0 AS i", "0 AS o", "1 AS q")))
    per_id = tagged.groupBy("event_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("q").alias("q"))
    return per_id.agg(
        F.sum("i").alias("events"), F.sum("o").alias("normalized"), F.sum("q").alias("quarantined"),
        F.expr("count_if(i > o + q)").alias("lost"), F.expr("count_if(i < o + q)").alias("invented"),
        F.expr("count_if(o > 0 AND q > 0)").alias("in_both"))


def traceability_audit(ok: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Records whose id or hash does not follow from their raw line, or that lost part of it.

    ``ok`` holds event documents, ``quarantine`` quarantine documents.
    """
    def checks(df, kind, candidates):
        ingest = "pipeline.ingest"
        return df.selectExpr(
            f"'{kind}' AS record", "event.id AS event_id",
            f"coalesce(event.id <> sha2(concat_ws(':', {ingest}.source, cast({ingest}.seq AS STRING), event.original), 256), true) AS bad_id",
            "coalesce(event.hash <> sha2(event.original, 256), true) AS bad_hash",
            "coalesce(event.original = '', true) AS no_raw",
            f"{candidates} AS bad_record")
    rows = checks(ok, "normalized", "false").unionByName(checks(
        quarantine, "quarantine",
        "coalesce(event.kind <> 'pipeline_error' OR size(pipeline.classification.candidates) = 0, true)"))
    return rows.groupBy("record").agg(
        F.count("*").alias("records"),
        *[F.expr(f"count_if({c})").alias(c) for c in ("bad_id", "bad_hash", "no_raw", "bad_record")])


def vocab_check(events: DataFrame) -> DataFrame:
    """Values of kind, category, type and outcome outside their vocabulary, with counts."""
    used = events.selectExpr(
        "inline(concat(array(named_struct('field', 'event.kind', 'value', event.kind), "
        "named_struct('field', 'event.outcome', 'value', event.outcome)), "
        "transform(event.category, v -> named_struct('field', 'event.category', 'value', v)), "
        "transform(event.type, v -> named_struct('field', 'event.type', 'value', v))))")
    counted = used.groupBy("field", "value").agg(F.count("*").alias("n"))
    # The vocabularies are fixed tables of a few dozen words.
    return counted.join(F.broadcast(vocabulary(events.sparkSession)), ["field", "value"], "left_anti")


def validate_specs(specs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Faults in source definitions: words outside the vocabulary, mapped paths outside the schema."""
    spark = specs.sparkSession
    words = specs.selectExpr("log_type", "inline(concat(array(named_struct('field', 'event.kind', 'value', event_kind)), "
                             "transform(event_category, v -> named_struct('field', 'event.category', 'value', v)), "
                             "transform(event_type, v -> named_struct('field', 'event.type', 'value', v))))")
    bad_words = words.join(F.broadcast(vocabulary(spark)), ["field", "value"], "left_anti")
    targets = specs.selectExpr("log_type", "explode(map_values(field_map)) AS value")
    paths = catalogue.filter("NOT metadata").selectExpr("path AS value")
    bad_paths = targets.join(F.broadcast(paths), "value", "left_anti").selectExpr(
        "'field_map' AS field", "value", "log_type")
    return bad_words.select("log_type", "field", "value").unionByName(bad_paths.select("log_type", "field", "value"))


def self_test(samples: DataFrame, specs: dict[str, SourceSpec]) -> DataFrame:
    """Run every source over its own samples (``log_type, raw``): lines, failures, first message."""
    from .route import union_all
    parts = [staged(samples.filter(F.col("log_type") == n).select("raw"), s)
             .selectExpr(f"{text(n)} AS log_type", "parse_error") for n, s in specs.items()]
    return union_all(parts).groupBy("log_type").agg(
        F.count("*").alias("n"), F.count("parse_error").alias("failed"), F.min("parse_error").alias("first_error"))


def source_errors(samples: DataFrame, specs: dict[str, SourceSpec], specs_table: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``log_type, error`` of the sources that must not be used: a sample that does not parse, or a faulty definition."""
    failed = self_test(samples, specs).filter("failed > 0").selectExpr("log_type", "concat('self-test: ', first_error) AS error")
    faulty = (validate_specs(specs_table, catalogue).groupBy("log_type")
              .agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "field", "value"))), ", ").alias("faults"))
              .selectExpr("log_type", "concat('not in the schema: ', faults) AS error"))
    return failed.unionByName(faulty).groupBy("log_type").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"))


def usable_specs(specs_table: DataFrame, errors: DataFrame) -> DataFrame:
    """The source table without the sources that have an error: :func:`..route.route` gives their lines ``no_plugin``."""
    # Both are tables of a row per source.
    return specs_table.join(F.broadcast(errors.select("log_type")), "log_type", "left_anti")


def field_coverage(events: DataFrame, paths: list[str]) -> DataFrame:
    """Share of events of each log type in which a field is present, one row per type and field."""
    present = [F.count(F.expr(".".join(name(p) for p in path.split(".")))).alias(path) for path in paths]
    wide = events.groupBy("log_type").agg(F.count("*").alias("_n"), *present)
    pairs = ", ".join(f"named_struct('field', {text(p)}, 'present', {name(p)})" for p in paths)
    return wide.selectExpr("log_type", "_n AS events", f"inline(array({pairs}))").selectExpr(
        "log_type", "field", "present", "round(present / events, 4) AS share")


def residual_keys(events: DataFrame) -> DataFrame:
    """How often each unmapped field occurs per source."""
    return (events.select("log_type", F.explode(F.map_keys("unmapped")).alias("key"))
            .groupBy("log_type", "key").agg(F.count("*").alias("n")))


def samples_frame(spark: SparkSession, samples: dict[str, list[str]]) -> DataFrame:
    """Sample lines per source as a table."""
    return spark.createDataFrame([(n, line) for n, lines in samples.items() for line in lines],
                                 "log_type string, raw string")
