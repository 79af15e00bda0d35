"""Routing: threshold, source look-up, parse outcome; and the quarantine record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import DEFAULT_THRESHOLD, PIPELINE_VERSION
from ..functions.sql import name, text
from ..sources.spec import SourceSpec
from .normalize import normalize, parse_failures, parsed, unparsed


def confidence_filter(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``log_type`` is the best ``label`` when its probability reaches the threshold, else 'unknown'.

    The comparison is made before ``confidence`` is rounded to four places.
    """
    carried = [name(c) for c in df.columns if c not in ("log_type", "confidence")]
    return df.selectExpr(*carried, f"CASE WHEN confidence >= {threshold}D THEN label ELSE 'unknown' END AS log_type",
                         "round(confidence, 4) AS confidence")


def route(df: DataFrame, specs: DataFrame) -> DataFrame:
    """Adds ``reason``: why a line cannot be parsed, or null when a source takes it."""
    # The table of sources has a row per definition in the code, so it is small.
    known = F.broadcast(specs.select("log_type", F.lit(True).alias("_known")))
    carried = [name(c) for c in df.columns if c != "reason"]
    return df.join(known, "log_type", "left").selectExpr(
        *carried, "CASE WHEN log_type = 'unknown' THEN 'low_confidence' "
                  "WHEN _known IS NULL THEN concat('no_plugin:', log_type) END AS reason")


def union_all(dfs) -> DataFrame:
    """One table from several, matching columns by name and filling the missing with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def normalize_routed(df: DataFrame, specs: dict[str, SourceSpec], year_hint: int | None = None,
                     now: str = "current_timestamp()") -> DataFrame:
    """All routable lines as documents: one filtered branch per source, then a union.

    Read ``df`` from a table partitioned by ``log_type`` and each branch scans
    only its own partition.
    """
    return union_all(normalize(df.filter((F.col("log_type") == n) & F.col("reason").isNull()), s, year_hint, now)
                     for n, s in specs.items())


def quarantined(df: DataFrame, specs: dict[str, SourceSpec]) -> DataFrame:
    """Everything that is not normalized: unroutable lines and parse failures, with ``reason``."""
    unroutable = df.filter("reason IS NOT NULL")
    failures = [parse_failures(df.filter((F.col("log_type") == n) & F.col("reason").isNull()), s)
                for n, s in specs.items()]
    return union_all([unroutable, *failures])


def outcomes(df: DataFrame, specs: dict[str, SourceSpec], year_hint: int | None = None,
             now: str = "current_timestamp()") -> DataFrame:
    """Every routed line once, as a document with its ``reason`` (null: normalized).

    Each source's patterns stand in the plan once. Store the result (it has ``outcome`` to partition it
    by), and let :func:`normalized_of` and :func:`quarantine_of` read the table.
    """
    parts = [unparsed(df.filter("reason IS NOT NULL"))]
    parts += [parsed(df.filter((F.col("log_type") == n) & F.col("reason").isNull()), s, year_hint, now) for n, s in specs.items()]
    # A source that is known but not given here takes no line.
    other = df.filter(F.col("reason").isNull() & ~F.col("log_type").isin(list(specs)))
    parts.append(unparsed(other.withColumn("reason", F.concat(F.lit("no_plugin:"), "log_type"))))
    return union_all(parts).withColumn("outcome", F.expr("CASE WHEN reason IS NULL THEN 'normalized' ELSE 'quarantined' END"))


def normalized_of(stored: DataFrame) -> DataFrame:
    """The event documents among stored outcomes."""
    return stored.filter("outcome = 'normalized'").drop("candidates", "reason", "outcome", "part")


def quarantine_of(stored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The quarantine documents among stored outcomes."""
    return to_quarantine(stored.filter("outcome = 'quarantined'").selectExpr(
        "event.original AS raw", "event.id AS event_id", "event.hash AS event_hash", "event.ingested AS received_at",
        "pipeline.ingest.source AS source", "pipeline.ingest.seq AS seq", "log_type",
        "pipeline.classification.confidence AS confidence", "candidates", "reason"), threshold)


def to_quarantine(df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Quarantine documents: error type and message from ``reason``, the raw line, full classification."""
    kind = "substring_index(reason, ':', 1)"
    detail = "CASE WHEN instr(reason, ':') > 0 THEN nullif(substring(reason, instr(reason, ':') + 1), '') END"
    below = f"concat('classifier confidence ', cast(confidence AS STRING), ' below threshold {threshold}')"
    return df.selectExpr(
        "received_at AS `@timestamp`",
        "named_struct('original', raw, 'id', event_id, 'hash', event_hash, 'ingested', received_at, "
        "'kind', 'pipeline_error', 'category', array('network'), 'type', array('error'), "
        "'module', 'pipeline', 'dataset', 'pipeline.quarantine') AS event",
        f"named_struct('type', {kind}, 'message', coalesce({detail}, "
        f"CASE WHEN reason = 'low_confidence' THEN {below} END, {kind})) AS error",
        "named_struct('file', named_struct('path', CASE WHEN instr(source, '://') = 0 THEN source END), "
        "'source', named_struct('address', CASE WHEN instr(source, '://') > 0 THEN source END)) AS log",
        f"named_struct('pipeline', named_struct('version', {text(PIPELINE_VERSION)}), "
        "'classification', named_struct('log_type', log_type, 'confidence', confidence, 'candidates', candidates), "
        "'ingest', named_struct('source', source, 'seq', seq)) AS pipeline",
        "reason")


def missing_specs(labels: DataFrame, specs: DataFrame) -> DataFrame:
    """Labels the classifier can give that no source takes."""
    return labels.join(F.broadcast(specs.select("log_type")), labels["label"] == specs["log_type"], "left_anti")
