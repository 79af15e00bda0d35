"""Sinks: normalized and quarantine JSON lines, run metrics, Parquet, fan-out."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.sql import json_text, name, text
from ..session import scratch_path, settle


def _present(path: str, kind) -> str:
    if isinstance(kind, StructType):
        return "(" + " OR ".join(_present(f"{path}.{name(f.name)}", f.dataType) for f in kind) + ")"
    return f"{path} IS NOT NULL"


def _sparse(path: str, kind) -> str:
    """The value with structs that hold nothing turned to null, level by level."""
    if not isinstance(kind, StructType):
        return path
    members = ", ".join(f"{text(f.name)}, {_sparse(f'{path}.{name(f.name)}', f.dataType)}" for f in kind)
    return f"CASE WHEN {_present(path, kind)} THEN named_struct({members}) END"


def document_json(df: DataFrame) -> DataFrame:
    """Event documents as JSON text (column ``value``): absent fields are left out.

    Unmapped fields go under their source's namespace, written exactly as kept.
    """
    skip = {"residual_ns", "unmapped", "event_ts", "log_type"}
    fields = [f for f in df.schema if f.name not in skip]
    members = ", ".join(f"{text(f.name)}, {_sparse(name(f.name), f.dataType)}" for f in fields)
    body = (f"array_join(transform(map_entries(unmapped), e -> concat({json_text('e.key')}, ':', e.value)), ',')")
    opened = "concat('\"', replace(residual_ns, '.', '\":{\"'), '\":{')"
    closed = "repeat('}', 2 + length(residual_ns) - length(replace(residual_ns, '.', '')))"
    return (df.selectExpr(f"to_json(named_struct({members})) AS _doc", "residual_ns", "unmapped")
            .selectExpr(f"CASE WHEN size(unmapped) > 0 THEN concat(left(_doc, length(_doc) - 1), ',', {opened}, "
                        f"{body}, {closed}) ELSE _doc END AS value"))


def quarantine_json(df: DataFrame) -> DataFrame:
    """Quarantine documents as JSON text; candidates are ``[label, probability]`` pairs."""
    meta = df.schema["pipeline"].dataType
    pairs = ("transform(pipeline.classification.candidates, c -> "
             "array(cast(c.label AS VARIANT), cast(c.p AS VARIANT)))")
    members = []
    for f in meta:
        inner = _sparse(f"pipeline.{name(f.name)}", f.dataType)
        if f.name == "classification":
            inner = ("named_struct('log_type', pipeline.classification.log_type, "
                     f"'confidence', pipeline.classification.confidence, 'candidates', {pairs})")
        members.append(f"{text(f.name)}, {inner}")
    tops = [f"{text(f.name)}, {_sparse(name(f.name), f.dataType)}" for f in df.schema
            if f.name not in ("pipeline", "reason")]
    return df.selectExpr(f"to_json(named_struct({', '.join(tops)}, 'pipeline', "
                         f"named_struct({', '.join(members)}))) AS value")


#: JSON lines repeat their keys: packed at the fastest level they still lose most of their room. Readers of text and JSON unpack them by the ending.
PACKED_TEXT = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Stored steps and tables take some two thirds of the default's room.
PACKED_TABLE = "zstd"


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Normalized events, one JSON document per line, in packed files."""
    document_json(df).write.mode(mode).options(**PACKED_TEXT).text(path)


def write_quarantine(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quarantined events, one JSON document per line, in packed files."""
    quarantine_json(df).write.mode(mode).options(**PACKED_TEXT).text(path)


def metrics_record(counters: dict[str, int], seconds: float | None = None, inputs=(), threshold: float | None = None,
                   sources=(), source_errors: dict[str, str] | None = None, missing_sources=()) -> dict:
    """The run's metrics from its counters (see :func:`..operators.summary.run_counters`)."""
    def part(prefix):
        return {k[len(prefix):]: n for k, n in counters.items() if k.startswith(prefix) and n}

    total, ok = counters["total"], counters["normalized"]
    record = {
        "events_total": total, "normalized": ok, "quarantined": total - ok, "success_rate": round(ok / total, 4) if total else None,
        "per_type_ok": part("ok:"), "quarantine": {"total": total - ok, "by_reason": part("reason:"), "by_type": part("bad:")},
        "inputs": list(inputs), "threshold": threshold, "sources": sorted(sources),
        "source_errors": dict(source_errors or {}), "missing_sources": sorted(missing_sources)}
    if seconds is not None:
        elapsed = max(seconds, 1e-9)
        record |= {"seconds": round(elapsed, 2), "eps": int(total / elapsed)}
    return record


METRICS_SCHEMA = """
events_total bigint, normalized bigint, quarantined bigint, success_rate double, per_type_ok map<string, bigint>,
quarantine struct<total: bigint, by_reason: map<string, bigint>, by_type: map<string, bigint>>,
inputs array<string>, threshold double, sources array<string>, source_errors map<string, string>,
missing_sources array<string>, seconds double, eps bigint
"""


def write_metrics(spark: SparkSession, record: dict, path: str) -> None:
    """The run's metrics as one JSON record."""
    (spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


#: Rows of a group that one file takes.
ROWS_PER_FILE = 250_000


def sized(df: DataFrame, keys: list[str], spread: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows dealt so that each value of ``keys`` is written by as many tasks as its size asks for.

    Give a stored table: it is counted by key first. A value's rows go to partitions of their
    own, dealt by the hash of ``spread``; a small value has one, so it becomes one file, and a
    large one is never gathered in one task.
    """
    taken = [f"_k{i}" for i in range(len(keys))]
    sizes = df.groupBy(*[F.col(name(k)).alias(t) for k, t in zip(keys, taken)]).agg(F.count("*").alias("_n"))
    shares = sizes.withColumn("_shares", F.ceil(F.col("_n") / rows_per_file).cast("int"))
    # One row per value of the keys.
    before = Window.orderBy(*taken).rowsBetween(Window.unboundedPreceding, -1)
    planned = settle(shares.withColumn("_first", F.coalesce(F.sum("_shares").over(before), F.lit(0)).cast("int")).drop("_n"))
    total = planned.agg(F.sum("_shares")).first()[0] or 1
    same = reduce(lambda a, b: a & b, [df[name(k)].eqNullSafe(planned[t]) for k, t in zip(keys, taken)])
    place = F.col("_first") + F.pmod(F.xxhash64(F.expr(spread)), F.col("_shares")).cast("int")
    return df.join(planned, same).repartitionById(int(total), place).drop(*taken, "_shares", "_first")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Normalized events by log type and event date, so readers prune on both; ``df`` is best a stored table."""
    dated = df.withColumn("event_date", F.to_date("event_ts"))
    (sized(dated, ["log_type", "event_date"], "event.id", rows_per_file)
     .write.mode(mode).option("compression", PACKED_TABLE).partitionBy("log_type", "event_date").parquet(path))


def fan_out(df: DataFrame, writers: list[Callable[[DataFrame], None]]) -> None:
    """Give the same rows to several sinks: they are written once to the shared folder, and every sink reads that table.

    A lost executor costs the files it was reading or writing, no row is computed twice.
    """
    path = scratch_path(df.sparkSession, "fan-out")
    df.write.option("compression", PACKED_TABLE).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    for write in writers:
        write(table)
