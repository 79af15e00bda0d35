"""Scans: numbered log lines, labelled corpora and quarantine files."""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.envelope import drop_blank
from .json_documents import fragments, records, tops

log = logging.getLogger(__name__)

# The text reader's path is a URI; local files are known by their plain path.
_SOURCE = "regexp_replace(url_decode(replace({0}, '+', '%2B')), '^file:/+', '/')"


def resolve(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files and folders to scan; a folder means its own files, a missing path only a warning."""
    jvm = spark._jvm
    hadoop = spark._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(hadoop)
        if not fs.exists(path):
            log.warning("not found: %s", p)
        elif not fs.getFileStatus(path).isDirectory():
            found.append(p)
        else:
            inside = list(fs.listStatus(path))
            if any(s.isDirectory() for s in inside):
                # Folders are not descended into, so name the files.
                names = (s.getPath().toString() for s in inside if not s.isDirectory())
                found += sorted(n for n in names if not n.rsplit("/", 1)[-1].startswith((".", "_")))
            elif inside:
                found.append(p)
    return found


def with_seq(lines: DataFrame) -> DataFrame:
    """Number the lines of each file from 1, in parallel and without moving them.

    ``lines`` has ``value`` and the reader's ``_file`` and ``_block`` (path and
    start of the split). Rows count up within a task, so a line's number is its
    place in its block plus the lines in the file's earlier blocks; only one
    row per block is ever shuffled.
    """
    at = lines.selectExpr("value", "_file", "_block", "monotonically_increasing_id() AS _at")
    blocks = at.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "_first",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # One row of some 150 bytes per file block: 0.12 GB for the 800,000 blocks of 100 TB.
    return at.join(F.broadcast(offsets), ["_file", "_block"]).selectExpr(
        f"{_SOURCE.format('_file')} AS source", "_before + _at - _first + 1 AS seq",
        "make_valid_utf8(value) AS raw")


def _literal(paths: list[str]) -> list[str]:
    """Paths whose names are no patterns for the reader."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def _readings(paths: list[str]) -> list[list[str]]:
    """The paths dealt so that no file is read twice at once; a repeated one goes to the next reading."""
    readings: list[tuple[list[str], set[str], set[str]]] = []
    for p in paths:
        plain = re.sub("^file:/+", "/", p).rstrip("/")
        folder = plain.rpartition("/")[0]
        fit = next((r for r in readings if plain not in r[1] and folder not in r[1] and plain not in r[2]), None)
        if fit is None:
            fit = ([], set(), set())
            readings.append(fit)
        fit[0].append(p)
        fit[1].add(plain)
        fit[2].add(folder)
    return [r[0] for r in readings]


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Log files to ``source, seq, raw``: one row per line that is not blank.

    Blank lines use up a number; bytes that are not UTF-8 become U+FFFD. A file that is
    named twice, or beside its folder, is read twice, and numbered from 1 each time.
    """
    paths = resolve(spark, [paths] if isinstance(paths, str) else list(paths))
    if not paths:
        return spark.createDataFrame([], "source string, seq bigint, raw string")
    parts = []
    for reading in _readings(paths):
        lines = spark.read.text(_literal(reading)).selectExpr(
            "value", "_metadata.file_path AS _file", "_metadata.file_block_start AS _block")
        parts.append(drop_blank(with_seq(lines)))
    return reduce(DataFrame.unionByName, parts)


def _files(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """The files of a folder with an ending, and the part files of its subfolders so called (a label whose table was written in parts)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    found = []
    for s in fs.listStatus(path) if fs.exists(path) else []:
        name = s.getPath().getName()
        if name.startswith((".", "_")) or not name.lower().endswith(ending):
            continue
        inside = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [i.getPath().toString() for i in inside if not i.isDirectory() and not i.getPath().getName().startswith((".", "_"))]
    return sorted(found)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A labelled corpus, ``label, line``: the label is the file name without its ending, or that of the folder ``<label>.log`` or ``<label>.json`` a file is in.

    ``.log`` files give their lines. ``.json`` files give their lines too if the
    first 20 all start with ``{``; else the file is one array, or an object whose
    first list-valued member is taken, and each record becomes a compact line. Such a file is read by as
    many tasks as it has blocks (see :mod:`.json_documents`). Other files are passed over.
    """
    label = "coalesce(nullif(regexp_extract({0}, '([^/]*)[.](?i:log|json)/[^/]*$', 1), ''), regexp_extract({0}, '([^/]*)[.][^./]*$', 1))"
    logs, documents = _files(spark, folder, ".log"), _files(spark, folder, ".json")
    parts = [read_lines(spark, logs).selectExpr(f"{label.format('source')} AS label", "raw AS line")]
    if documents:
        # A row per file: whether it begins as an array, or else has a first line that is no record.
        starts = {r.file: r.top for r in tops(fragments(spark, _literal(documents))).collect()}
        objects = [f for f, top in starts.items() if top == "{"]
        whole = {f for f, top in starts.items() if top != "{"}
        if objects:
            lines = read_lines(spark, [_plain(f) for f in objects])
            heads = lines.filter("seq <= 1000").withColumn("_i", F.row_number().over(Window.partitionBy("source").orderBy("seq"))).filter("_i <= 20")
            by_line = {r.source for r in heads.groupBy("source").agg(F.expr("bool_and(startswith(ltrim(raw), '{'))").alias("b")).filter("b").collect()}
            parts.append(lines.filter(F.col("source").isin(list(by_line))).selectExpr(f"{label.format('source')} AS label", "raw AS line"))
            whole |= {f for f in objects if _plain(f) not in by_line}
        if whole:
            found, none = records(fragments(spark, _literal(sorted(map(_plain, whole)))))
            # A record that is no JSON is a line as it stands: it is seen and not lost. So is a document without a list.
            parts.append(found.selectExpr(f"{label.format(_SOURCE.format('file'))} AS label", "coalesce(to_json(try_parse_json(record)), record) AS line"))
            listless = [r.file for r in none.collect()]
            if listless:
                text = spark.read.text(_literal([_plain(f) for f in listless]), wholetext=True)
                parts.append(text.selectExpr(f"{label.format(_SOURCE.format('_metadata.file_path'))} AS label", "make_valid_utf8(value) AS line"))
    return reduce(DataFrame.unionByName, parts)


def _plain(file: str) -> str:
    """A reader's URI as the path it was made from."""
    from urllib.parse import unquote
    return unquote(re.sub("^file:/+", "/", file))


QUARANTINE_SCHEMA = """
`@timestamp` string,
event struct<original: string, id: string, hash: string, ingested: string, kind: string,
             category: array<string>, type: array<string>, module: string, dataset: string>,
error struct<type: string, message: string>,
log struct<file: struct<path: string>, source: struct<address: string>>,
pipeline struct<pipeline: struct<version: string>,
                classification: struct<log_type: string, confidence: double, candidates: array<array<string>>>,
                ingest: struct<source: string, seq: bigint>>
"""


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Quarantine JSONL to ``kind, detail, raw, log_type, confidence, candidates, source, seq``."""
    return spark.read.schema(QUARANTINE_SCHEMA).json(path).selectExpr(
        "error.type AS kind", "error.message AS detail", "event.original AS raw",
        "pipeline.classification.log_type AS log_type", "pipeline.classification.confidence AS confidence",
        "transform(pipeline.classification.candidates, c -> named_struct('label', c[0], 'p', try_cast(c[1] AS DOUBLE))) "
        "AS candidates",
        "pipeline.ingest.source AS source", "pipeline.ingest.seq AS seq")
