"""Scans, sinks, quarantine review and streaming, on files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review
from ..operators.route import union_all
from ..session import scratch_path
from ..sources import sinks
from ..sources.scan import read_corpus, read_lines, read_quarantine
from . import render
from .model_queries import _CORPUS_SQL, CORPUS, corpus
from .query import Query, table
from .record_queries import _BAD, _OK, events, quarantine
from .render import RENDERINGS, mixed_sql

# Lines for scans: every tenth row is a blank line; keys count up along each file.
_LINE = "concat('order ', o_orderkey, ' ', o_orderpriority, ' ', o_orderstatus)"


def _write_orders(spark, sf_dir, folder):
    """The orders as text files, each holding a run of consecutive keys in order."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (table(spark, sf_dir, "orders").repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey")
     .selectExpr(f"CASE WHEN o_orderkey % 10 = 9 THEN '  ' ELSE {_LINE} END AS value").write.text(folder))
    return folder


def _read_lines(spark, sf_dir):
    lines = read_lines(spark, _write_orders(spark, sf_dir, scratch_path(spark, "lines")))
    return lines.select("raw")


def _line_numbers(spark, sf_dir):
    """A line's number follows its key all along a file, blank lines included."""
    lines = read_lines(spark, _write_orders(spark, sf_dir, scratch_path(spark, "numbers")))
    offset = lines.selectExpr("source", "seq", "cast(split(raw, ' ')[1] AS BIGINT) - seq AS offset")
    files = offset.groupBy("source").agg(F.count("*").alias("n"), F.min("seq").alias("first"),
                                         F.min("offset").alias("low"), F.max("offset").alias("high"))
    return files.agg(F.sum("n").alias("lines"), F.expr("count_if(low <> high)").alias("broken_files"),
                     F.expr("count_if(first > 2)").alias("late_files"))


def _union_inputs(spark, sf_dir):
    """A folder, single files of another folder, and a path that does not exist, as one stream."""
    a, b = scratch_path(spark, "in-a"), scratch_path(spark, "in-b")
    table(spark, sf_dir, "customer").selectExpr("c_name AS value").write.text(a)
    table(spark, sf_dir, "supplier").selectExpr("s_name AS value").write.text(b)
    path = spark._jvm.org.apache.hadoop.fs.Path(b)
    inside = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = [s.getPath().toString() for s in inside if s.getPath().getName().endswith(".txt")]
    return read_lines(spark, [a, *files, f"{a}-missing"]).select("raw")


_CORPUS_LOGS = [n for n in CORPUS if not n.startswith("zeek")]


def _corpus_scan(spark, sf_dir):
    """A folder of part files per label: plain lines, JSON lines, arrays, and an array inside an object after other members."""
    folder = scratch_path(spark, "corpus")
    lines = corpus(spark, sf_dir)
    for label in _CORPUS_LOGS:
        lines.filter(F.col("label") == label).select("line").write.text(f"{folder}/{label}.log")
    lines.filter("label = 'zeek_dns'").select("line").write.text(f"{folder}/zeek_dns.json")
    table(spark, sf_dir, "nation").selectExpr("n_name AS line").write.text(f"{folder}/notes.txt")
    # A document per group of rows and file, together as large as the table.
    record = "to_json(named_struct('k', {0}, 'n', concat({1}, ' }} ,[')))"
    arrays = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey % 7").alias("g")).agg(
        F.expr(f"concat('[\n ', array_join(collect_list({record.format('o_orderkey', 'o_orderpriority')}), ',\n '), '\n]\n')").alias("line"))
    arrays.repartitionById(7, F.col("g").cast("int")).select("line").write.option("lineSep", "\n\n").text(f"{folder}/zeek_conn.json")
    objects = table(spark, sf_dir, "region").selectExpr(
        "r_regionkey", f"concat('{{\\n\"kind\": {{\"list\": [1]}},\\n\"rows\": [', {record.format('r_regionkey', 'r_name')}, '], \"more\": [3], \"last\": {{\"x\": 1}}\n}}') AS line")
    objects.repartitionById(5, F.col("r_regionkey").cast("int")).select("line").write.text(f"{folder}/zeek_http.json")
    return read_corpus(spark, folder)


_CORPUS_SCAN_SQL = f"""
SELECT label, line FROM ({_CORPUS_SQL}) WHERE label = 'zeek_dns' OR label NOT LIKE 'zeek%'
UNION ALL SELECT 'zeek_conn', '{{"k":' || o_orderkey || ',"n":"' || o_orderpriority || ' }} ,["}}' FROM orders
UNION ALL SELECT 'zeek_http', '{{"k":' || r_regionkey || ',"n":"' || r_name || ' }} ,["}}' FROM region"""

# --- quarantine review ---------------------------------------------------------------
_REVIEW = {
    "kind": "CASE event_type WHEN 'error' THEN 'parse_error' WHEN 'signup' THEN 'no_plugin' ELSE 'low_confidence' END",
    "detail": "CASE event_type WHEN 'error' THEN concat('ValueError:', CASE WHEN event_id % 3 = 0 THEN 'bad header in a very long message that is cut off after eighty characters, at id ' "
              "ELSE 'bad count ' END, event_id % 4) WHEN 'signup' THEN concat('type_', user_id % 5) ELSE 'low' END",
    "log_type": "CASE WHEN event_type = 'error' THEN concat('src_', user_id % 3) ELSE 'unknown' END",
    "raw": "CASE WHEN event_id % 3 = 0 THEN concat('conn ', event_id, ' from 10.', user_id % 250, '.0.', event_id % 250, '  by ', event_type, ' key ', md5(event_type)) "
           "ELSE concat(event_type, ' alert level ', user_id % 7, ' zone-', substr('abcdefgh', 1 + user_id % 8, 1)) END",
    "source": "concat('/logs/', user_id % 3, '.log')",
    "seq": "event_id",
}
_REVIEW_SQL = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _REVIEW.items())} FROM events"
_MASKED_SQL = ("substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b', '<IP>', 'g'), "
               "'\\b[0-9a-fA-F]{12,}\\b', '<HEX>', 'g'), '\\d+', '<N>', 'g'), '\\s+', ' ', 'g'), 1, 160)")
_CLUSTERED_SQL = f"SELECT *, {_MASKED_SQL} AS template FROM ({_REVIEW_SQL}) WHERE kind = 'low_confidence'"
_RANKED_SQL = f"""
SELECT template, n, row_number() OVER (ORDER BY n DESC, source, seq) AS rank FROM (
  SELECT template, count(*) AS n, min(source) AS source, arg_min(seq, (source, seq)) AS seq FROM ({_CLUSTERED_SQL}) GROUP BY template)"""


def review_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in _REVIEW.items()])


def _exported(spark, sf_dir):
    path = scratch_path(spark, "clusters")
    review.export_clusters(review_rows(spark, sf_dir), path)
    return spark.read.text(path).selectExpr("cast(cluster AS BIGINT) AS rank", "value AS raw")


# --- sinks -----------------------------------------------------------------------------
def _write_normalized(spark, sf_dir):
    path = scratch_path(spark, "normalized")
    sinks.write_jsonl(events(spark, sf_dir), path)
    return spark.read.text(path).selectExpr(
        "cast(get_json_object(value, '$.pipeline.ingest.seq') AS BIGINT) AS seq",
        "get_json_object(value, '$.event.dataset') AS dataset",
        "cast(get_json_object(value, '$.pipeline.classification.confidence') AS DOUBLE) AS confidence")


_WRITE_NORMALIZED_SQL = f"""
SELECT seq, CASE label WHEN 'snort_alert' THEN 'snort.alert' WHEN 'web_access' THEN 'apache.access' ELSE 'zeek.dns' END AS dataset,
  round(p1, 4) AS confidence FROM {_OK}"""


def _quarantine_round_trip(spark, sf_dir):
    path = scratch_path(spark, "quarantine")
    sinks.write_quarantine(quarantine(spark, sf_dir), path)
    return read_quarantine(spark, path)


def _quarantine_scan(spark, sf_dir):
    return _quarantine_round_trip(spark, sf_dir).selectExpr(
        "seq", "source", "kind", "log_type", "confidence", "candidates[0].label AS label", "candidates[1].p AS second_p")


_QUARANTINE_SCAN_SQL = f"""
SELECT seq, src AS source, kind, log_type, round(p1, 4) AS confidence, label, round((1 - p1) / 2, 4) AS second_p FROM {_BAD}"""


def _write_quarantine(spark, sf_dir):
    return _quarantine_round_trip(spark, sf_dir).groupBy("kind").agg(
        F.count("*").alias("n"), F.count("raw").alias("with_raw"), F.sum(F.size("candidates")).alias("n_candidates"))


def _write_metrics(spark, sf_dir):
    """The record of counters taken while the outcomes of the mixed lines are written."""
    from .pipeline import write_outcomes
    from .record_queries import MIXED_SOURCES, routed
    path = scratch_path(spark, "metrics")
    _, counters = write_outcomes(routed(spark, sf_dir), f"{path}-outcomes", MIXED_SOURCES, ["miscellaneous"], render.YEAR)
    sinks.write_metrics(spark, sinks.metrics_record(counters, None, ["/logs/mixed.log"], 0.6, MIXED_SOURCES), path)
    return sinks.read_metrics(spark, path).selectExpr(
        "events_total", "normalized", "quarantined", "success_rate", "threshold", "array_join(sources, ',') AS sources",
        "array_join(inputs, ',') AS inputs", "per_type_ok['zeek_dns'] AS dns", "quarantine.by_reason['parse_error'] AS parse_errors",
        "quarantine.by_type['unknown'] AS unknown", "quarantine.total AS total_bad")


_WRITE_METRICS_SQL = f"""
SELECT count(*) AS events_total, count(*) FILTER (kind IS NULL) AS normalized, count(*) FILTER (kind IS NOT NULL) AS quarantined,
  round(count(*) FILTER (kind IS NULL) / count(*), 4) AS success_rate, CAST(0.6 AS DOUBLE) AS threshold,
  'snort_alert,web_access,zeek_dns' AS sources, '/logs/mixed.log' AS inputs,
  nullif(count(*) FILTER (kind IS NULL AND label = 'zeek_dns'), 0) AS dns, nullif(count(*) FILTER (kind = 'parse_error'), 0) AS parse_errors,
  nullif(count(*) FILTER (log_type = 'unknown'), 0) AS unknown, count(*) FILTER (kind IS NOT NULL) AS total_bad FROM ({mixed_sql()})"""


def _write_parquet(spark, sf_dir):
    path = scratch_path(spark, "events")
    sinks.write_parquet(events(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy("log_type", F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


# Web and IDS lines carry the event's own time; look-ups the epoch they were rendered with.
_WRITE_PARQUET_SQL = f"""
SELECT label AS log_type, CASE WHEN label = 'zeek_dns' THEN strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%d')
  ELSE strftime(ts, '%Y-%m-%d') END AS day, count(*) AS n FROM {_OK} GROUP BY 1, 2"""


def _fan_out(spark, sf_dir):
    a, b = scratch_path(spark, "out-a"), scratch_path(spark, "out-b")
    sinks.fan_out(events(spark, sf_dir), [lambda df: sinks.write_jsonl(df, a), lambda df: df.select("log_type", "event.id").write.parquet(b)])
    first = spark.read.text(a).selectExpr("'jsonl' AS sink", "get_json_object(value, '$.event.id') AS id")
    return first.unionByName(spark.read.parquet(b).selectExpr("'parquet' AS sink", "id")).groupBy("sink").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


_FAN_OUT_SQL = f"""
SELECT unnest(['jsonl', 'parquet']) AS sink, n, n AS n_ids FROM (SELECT count(*) AS n FROM {_OK})"""


# --- streaming ---------------------------------------------------------------------------
def _stream(spark, sf_dir, log_type):
    """Rendered lines as files, streamed to the end; both outputs by batch."""
    source = scratch_path(spark, "stream-in")
    RENDERINGS[log_type].lines(spark, sf_dir).select("raw").repartition(4).write.text(source)
    return _streamed(spark, source, log_type)


def _streamed(spark, source, log_type):
    from ..streaming import stream_normalize
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    query = stream_normalize(spark, source, out, state, log_type=log_type, year_hint=render.YEAR,
                             specs={log_type: _source(log_type)}, trigger={"availableNow": True}, max_files=2)
    query.awaitTermination()
    return out


def _source(log_type):
    from ..sources import SOURCES
    return SOURCES[log_type]


def _stream_normalize(spark, sf_dir):
    out = _stream(spark, sf_dir, "web_access")
    return spark.read.text(f"{out}/normalized").selectExpr(
        "get_json_object(value, '$.event.outcome') AS outcome",
        "cast(get_json_object(value, '$.http.response.status_code') AS BIGINT) AS status").groupBy("outcome", "status").agg(
        F.count("*").alias("n"))


_WEB = RENDERINGS["web_access"].facts_sql()
_STREAM_NORMALIZE_SQL = f"""
SELECT CASE WHEN code < 400 THEN 'success' ELSE 'failure' END AS outcome, CAST(code AS BIGINT) AS status, count(*) AS n
FROM ({_WEB}) WHERE NOT broken GROUP BY 1, 2"""


def _stream_dual(spark, sf_dir):
    out = _stream(spark, sf_dir, "snort_alert")
    parts = [spark.read.text(f"{out}/{kind}").selectExpr(f"'{kind}' AS sink", "get_json_object(value, '$.event.id') AS id")
             for kind in ("normalized", "quarantine")]
    return union_all(parts).groupBy("sink").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


_STREAM_DUAL_SQL = f"""
SELECT CASE WHEN broken THEN 'quarantine' ELSE 'normalized' END AS sink, count(*) AS n, count(*) AS n_ids
FROM ({RENDERINGS['snort_alert'].facts_sql()}) GROUP BY 1"""


def _stream_counters(spark, sf_dir):
    from ..streaming import stream_counters
    from .record_queries import routed
    source, state = scratch_path(spark, "routed"), scratch_path(spark, "counter-state")
    routed(spark, sf_dir).select("log_type", "reason").repartition(4).write.parquet(source)
    stream = spark.readStream.schema("log_type string, reason string").option("maxFilesPerTrigger", 2).parquet(source)
    out = scratch_path(spark, "counters")

    def keep(df, batch_id):
        # Complete mode: the batch is the whole table of counters, a row per type and kind.
        df.write.mode("overwrite").parquet(f"{out}/{batch_id:08d}")

    query = (stream_counters(stream).writeStream.outputMode("complete").foreachBatch(keep)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return spark.read.parquet(f"{out}/{last:08d}")


_STREAM_COUNTERS_SQL = f"""
SELECT log_type, CASE WHEN log_type = 'unknown' THEN 'low_confidence' WHEN log_type = 'miscellaneous' THEN 'no_plugin' ELSE 'normalized' END AS kind,
  count(*) AS n FROM ({mixed_sql()}) GROUP BY 1, 2"""


def _stream_totals(spark, sf_dir):
    """Totals of the ledger after a stream that lost the record of its first batch, whose lines another batch takes.

    Files without a record do not count, so the lines count by the other batch alone; that one is played twice
    and counts once, with its files replaced.
    """
    from ..streaming import committed, normalize_batch, stream_totals
    source = scratch_path(spark, "stream-in")
    RENDERINGS["snort_alert"].lines(spark, sf_dir).select("raw").repartition(4).write.text(source)
    out = _streamed(spark, source, "snort_alert")
    _remove(spark, f"{out}/ledger/batch=0")
    # A batch of the stream has two files.
    first = spark.read.schema("pipeline struct<ingest: struct<source: string>>").parquet(f"{out}/outcomes/batch=0")
    files = [r.file for r in first.selectExpr("substring_index(pipeline.ingest.source, '/', -1) AS file").distinct().collect()]
    again = (spark.read.text(source).filter(F.col("_metadata.file_name").isin(files))
             .selectExpr("value", "_metadata.file_path AS _file", "_metadata.file_block_start AS _block"))
    for _ in range(2):
        normalize_batch(again, 99, out, log_type="snort_alert", year_hint=render.YEAR, specs={"snort_alert": _source("snort_alert")})
    lines = union_all([committed(spark, out, kind).selectExpr(f"'{kind} lines' AS counter") for kind in ("normalized", "quarantine")])
    return union_all([stream_totals(spark, out), lines.groupBy("counter").agg(F.count("*").alias("n"))])


def _remove(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_STREAM_TOTALS_SQL = f"""
WITH r AS (SELECT broken FROM ({RENDERINGS['snort_alert'].facts_sql()}))
SELECT 'total' AS counter, count(*) AS n FROM r UNION ALL SELECT 'normalized', count(*) FILTER (NOT broken) FROM r
UNION ALL SELECT 'ok:snort_alert', count(*) FILTER (NOT broken) FROM r UNION ALL SELECT 'bad:snort_alert', count(*) FILTER (broken) FROM r
UNION ALL SELECT 'reason:parse_error', count(*) FILTER (broken) FROM r
UNION ALL SELECT 'normalized lines', count(*) FILTER (NOT broken) FROM r UNION ALL SELECT 'quarantine lines', count(*) FILTER (broken) FROM r"""

QUERIES = [
    Query("read_lines", _read_lines, f"SELECT {_LINE} AS raw FROM orders WHERE o_orderkey % 10 < 9"),
    Query("line_numbers", _line_numbers,
          "SELECT count(*) AS lines, CAST(0 AS BIGINT) AS broken_files, CAST(0 AS BIGINT) AS late_files FROM orders WHERE o_orderkey % 10 < 9"),
    Query("union_inputs", _union_inputs, "SELECT c_name AS raw FROM customer UNION ALL SELECT s_name FROM supplier"),
    Query("corpus_scan", _corpus_scan, _CORPUS_SCAN_SQL),
    Query("quarantine_scan", _quarantine_scan, _QUARANTINE_SCAN_SQL),
    Query("reason_counts", lambda s, d: review.reason_counts(review_rows(s, d)),
          f"SELECT kind, count(*) AS n FROM ({_REVIEW_SQL}) GROUP BY kind"),
    Query("no_plugin_counts", lambda s, d: review.no_plugin_counts(review_rows(s, d)),
          f"SELECT detail AS log_type, count(*) AS n FROM ({_REVIEW_SQL}) WHERE kind = 'no_plugin' GROUP BY detail"),
    Query("parse_error_groups", lambda s, d: review.parse_error_groups(review_rows(s, d)),
          f"SELECT log_type, substr(detail, 1, 80) AS message, count(*) AS n FROM ({_REVIEW_SQL}) WHERE kind = 'parse_error' GROUP BY 1, 2"),
    Query("parse_error_samples", lambda s, d: review.parse_error_samples(review_rows(s, d), None),
          f"SELECT log_type, message, r AS rank, substr(raw, 1, 150) AS sample, group_size FROM (SELECT *, row_number() OVER (PARTITION BY log_type, message ORDER BY source, seq) AS r, "
          f"count(*) OVER (PARTITION BY log_type, message) AS group_size FROM (SELECT *, substr(detail, 1, 80) AS message FROM ({_REVIEW_SQL}) WHERE kind = 'parse_error')) WHERE r <= 2"),
    Query("template_clusters", lambda s, d: review.cluster(review_rows(s, d)).selectExpr(
        "template", "n", "first.source AS source", "first.seq AS seq"),
        f"SELECT template, count(*) AS n, min(source) AS source, arg_min(seq, (source, seq)) AS seq FROM ({_CLUSTERED_SQL}) GROUP BY template"),
    Query("cluster_rank", lambda s, d: review.cluster_rank(review_rows(s, d)).select("rank", "template", "n"),
          f"SELECT rank, template, n FROM ({_RANKED_SQL}) WHERE rank <= 10"),
    Query("cluster_rank_all", lambda s, d: review.cluster_rank(review_rows(s, d), None).select("rank", "template", "n"),
          f"SELECT rank, template, n FROM ({_RANKED_SQL})"),
    Query("cluster_samples", lambda s, d: review.cluster_samples(review_rows(s, d)),
          f"SELECT template, r AS rank, substr(raw, 1, 150) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY source, seq) AS r "
          f"FROM ({_CLUSTERED_SQL})) WHERE r <= 2"),
    Query("export_clusters", _exported, f"SELECT rank, raw FROM ({_CLUSTERED_SQL}) JOIN ({_RANKED_SQL}) USING (template)"),
    Query("write_normalized_jsonl", _write_normalized, _WRITE_NORMALIZED_SQL),
    Query("write_quarantine_jsonl", _write_quarantine,
          f"SELECT kind, count(*) AS n, count(*) AS with_raw, 2 * count(*) AS n_candidates FROM {_BAD} GROUP BY kind"),
    Query("write_metrics", _write_metrics, _WRITE_METRICS_SQL),
    Query("write_parquet", _write_parquet, _WRITE_PARQUET_SQL),
    Query("fan_out", _fan_out, _FAN_OUT_SQL),
    Query("stream_normalize", _stream_normalize, _STREAM_NORMALIZE_SQL),
    Query("stream_dual_sink", _stream_dual, _STREAM_DUAL_SQL),
    Query("stream_counters", _stream_counters, _STREAM_COUNTERS_SQL),
    Query("stream_totals", _stream_totals, _STREAM_TOTALS_SQL),
]
