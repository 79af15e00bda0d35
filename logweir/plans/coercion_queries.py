"""Scalar functions over text rendered from the tables."""

from __future__ import annotations

from ..catalogue import EVENT_FIELDS
from ..functions import coerce as c
from ..functions.sql import json_text
from ..functions.textual import Perturbation, kv_last, mask_template, perturb, url_stages
from ..operators.envelope import drop_blank
from .query import Query, table

# Text columns as Spark SQL, and the value expected as DuckDB SQL over the same row.
_NOTATION = {
    0: ("cast(unix_seconds(cast(ts AS TIMESTAMP)) AS STRING)", "s000"),
    1: ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")", "ms"),
    2: ("concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+0200')", "two_hours"),
    3: ("concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000')", "s000"),
    4: ("date_format(ts, 'MMM d HH:mm:ss')", "s000"),
    5: ("date_format(ts, 'MM/dd-HH:mm:ss.SSSSSS')", "ms"),
    6: ("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "s000"),
    7: ("date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "s000"),
    8: ("concat('day ', event_id)", "text"),
    9: ("cast(event_id AS STRING)", "number"),
}
_EXPECTED_TS = {
    "s000": "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.000+00:00')",
    "ms": "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(CAST(floor(microsecond(ts) % 1000000 / 1000) AS BIGINT) AS VARCHAR), 3, '0'), '+00:00')",
    "two_hours": "concat(strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S'), '.000+00:00')",
    "text": "concat('day ', event_id)",
    "number": "CAST(event_id AS VARCHAR)",
}


def _timestamps(spark, sf_dir):
    arms = " ".join(f"WHEN {k} THEN {e}" for k, (e, _) in _NOTATION.items())
    return (table(spark, sf_dir, "events").selectExpr("event_id", f"CASE event_id % 10 {arms} END AS x")
            .selectExpr("event_id", f"{c.coerce_timestamp('x', 2024)} AS ts_text"))


_TIMESTAMPS_SQL = ("SELECT event_id, CASE event_id % 10 "
                   + " ".join(f"WHEN {k} THEN {_EXPECTED_TS[e]}" for k, (_, e) in _NOTATION.items())
                   + " END AS ts_text FROM events")


def _year_guess(spark, sf_dir):
    """Without a year hint: the year of now, or the one before when that lies ahead."""
    return (table(spark, sf_dir, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'MMM d HH:mm:ss') AS x")
            .selectExpr("o_orderkey", f"{c.coerce_timestamp('x', None, 'timestamp_seconds(1715688000)')} AS ts_text"))


# 1715688000 is 2024-05-14 12:00 UTC; 29 February exists in 2024 only.
_YEAR_GUESS_SQL = """
SELECT o_orderkey, concat(CASE WHEN strftime(o_orderdate, '%m-%d') <= '05-15' THEN '2024' ELSE '2023' END,
                          strftime(o_orderdate, '-%m-%d'), 'T00:00:00.000+00:00') AS ts_text FROM orders"""


def _durations(spark, sf_dir):
    text = ("CASE l_linenumber % 5 WHEN 0 THEN concat(l_orderkey % 30, ':', lpad(l_partkey % 60, 2, '0'), ':', lpad(l_suppkey % 60, 2, '0')) "
            "WHEN 1 THEN concat(l_partkey % 60, ':', lpad(l_suppkey % 60, 2, '0')) WHEN 2 THEN cast(l_partkey AS STRING) "
            "WHEN 3 THEN concat(l_partkey, '.5') ELSE 'a:b' END")
    return (table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{text} AS x")
            .selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{c.coerce_duration_ns('x')} AS ns"))


_DURATIONS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5
  WHEN 0 THEN (l_orderkey % 30 * 3600 + l_partkey % 60 * 60 + l_suppkey % 60) * 1000000000
  WHEN 1 THEN (l_partkey % 60 * 60 + l_suppkey % 60) * 1000000000
  WHEN 2 THEN l_partkey * 1000000000
  WHEN 3 THEN l_partkey * 1000000000 + 500000000 END AS ns FROM lineitem"""


def _numbers(spark, sf_dir):
    text = ("CASE l_linenumber % 6 WHEN 0 THEN cast(l_partkey AS STRING) WHEN 1 THEN concat(l_partkey, '.75') "
            "WHEN 2 THEN concat(' ', l_suppkey, ' ') WHEN 3 THEN '-' WHEN 4 THEN concat('-', l_partkey, '.5') ELSE concat(l_partkey, 'd') END")
    return (table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{text} AS x")
            .selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{c.coerce_long('x')} AS whole",
                        f"{c.coerce_double('trim(x)')} AS number"))


_NUMBERS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_linenumber % 6 WHEN 0 THEN l_partkey WHEN 1 THEN l_partkey WHEN 2 THEN l_suppkey WHEN 4 THEN -l_partkey END AS whole,
  CASE l_linenumber % 6 WHEN 0 THEN CAST(l_partkey AS DOUBLE) WHEN 1 THEN l_partkey + CAST(0.75 AS DOUBLE)
    WHEN 2 THEN CAST(l_suppkey AS DOUBLE) WHEN 4 THEN -(l_partkey + CAST(0.5 AS DOUBLE)) END AS number FROM lineitem"""


def _booleans(spark, sf_dir):
    text = "element_at(array('1', 'TRUE', 't', 'Yes', '0', 'no', 'on'), cast(o_orderkey % 7 + 1 AS INT))"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS x").selectExpr(
        "o_orderkey", f"cast({c.coerce_bool('x')} AS INT) AS flag")


_IP_TEXT = """CASE event_id % 10
  WHEN 0 THEN concat('10.', user_id % 250, '.', event_id % 250, '.1') WHEN 1 THEN concat(' 37.0.0.', user_id % 250, ' ')
  WHEN 2 THEN '01.2.3.4' WHEN 3 THEN concat('10.0.0.', 256 + user_id) WHEN 4 THEN concat('2001:DB8:0:0:0:0:0:', 1 + user_id % 9)
  WHEN 5 THEN concat('2001:0db8::00', 10 + user_id % 90, ':0:0:1') WHEN 6 THEN '::FFFF:1.2.3.4' WHEN 7 THEN concat('host', user_id)
  WHEN 8 THEN '1:2:3' ELSE '::' END"""
_IP_EXPECTED = """CASE event_id % 10
  WHEN 0 THEN concat('10.', user_id % 250, '.', event_id % 250, '.1') WHEN 1 THEN concat('37.0.0.', user_id % 250)
  WHEN 4 THEN concat('2001:db8::', 1 + user_id % 9) WHEN 5 THEN concat('2001:db8::', 10 + user_id % 90, ':0:0:1')
  WHEN 6 THEN '::ffff:102:304' WHEN 9 THEN '::' END"""


def _ips(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_IP_TEXT} AS x").selectExpr(
        "event_id", f"{c.coerce_ip('x')} AS ip")


def _arrays(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", f"{_IP_TEXT} AS x")
    df = df.selectExpr("event_id", "array(x, concat('10.9.8.', event_id % 250), 'junk') AS many", "array(x) AS one", "event_type")
    return df.selectExpr("event_id", f"array_join({c.coerce('ip[]', 'many', 'array<string>')}, ',') AS many",
                         f"array_join({c.coerce('ip[]', 'one', 'array<string>')}, ',') AS one",
                         f"array_join({c.coerce('keyword[]', 'event_type', 'string')}, ',') AS words")


_ARRAYS_SQL = f"""
SELECT event_id, coalesce(ip || ',', '') || '10.9.8.' || (event_id % 250) AS many, ip AS one, event_type AS words
FROM (SELECT *, {_IP_EXPECTED} AS ip FROM events)"""


def _urls(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", "url")
    kept = ["page_id", "url"]
    for stage in url_stages("_l", "url"):
        df = df.selectExpr(*kept, *[f"{e} AS {n}" for n, e in stage.items()])
        kept += list(stage)
    return df.selectExpr("page_id", "_l_scheme AS scheme", "_l_host AS host", "_l_port AS port", "_l_path AS path",
                         "_l_query AS query")


_URLS_SQL = """
SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme,
  lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host,
  CAST(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#:]+:([0-9]+)', 1), '') AS BIGINT) AS port,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path,
  nullif(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '') AS query FROM pages"""


def _pairs(spark, sf_dir):
    text = ("concat('user=', o_custkey, ' note=a=b status=', o_orderstatus, ' user=', o_orderkey, ' xuser=1 ', "
            "CASE WHEN o_orderkey % 3 = 0 THEN concat('price=', cast(floor(o_totalprice) AS BIGINT)) ELSE 'plain' END)")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS x").selectExpr(
        "o_orderkey", *[f"{kv_last('x', k)} AS {n}" for k, n in (
            ("user", "who"), ("note", "note"), ("status", "status"), ("price", "price"))])


_PAIRS_SQL = """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS who, 'a=b' AS note, o_orderstatus AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price FROM orders"""


def _templates(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{mask_template('text')} AS template")


_TEMPLATES_SQL = """
SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b', '<IP>', 'g'), '\\b[0-9a-fA-F]{12,}\\b', '<HEX>', 'g'), '\\d+', '<N>', 'g'),
  '\\s+', ' ', 'g'), 1, 160) AS template FROM documents"""

# Lines with everything the perturbation touches.
PERTURB_TEXT = ("concat('Mar 07 12:00 gate-north-', c_nationkey, ' from 198.18.', c_nationkey, '.', c_custkey % 250, ' to 203.0.113.', c_nationkey, "
                "' at 1650000', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ' 2023-03-07 07/Mar/2023 03/07- heron HERON ', c_name)")
PERTURB_RULES = Perturbation(
    texts=(("Mar 07", "Oct 21"), ("2023-03-07", "2025-10-21"), ("07/Mar/2023", "21/Oct/2025"), ("03/07-", "10/21-"), ("heron", "wren"), ("HERON", "WREN")),
    hosts=("\\bgate-north-\\d+", "gate-south-5"), epochs="1650000\\d+")


def _perturbed(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{PERTURB_TEXT} AS x").selectExpr(
        "c_custkey", f"{perturb('x', 7, PERTURB_RULES)} AS line")


def _draw_sql(tag, i, low, span):
    return f"({low} + CAST('0x' || substr(sha256(concat(x, ':7:{tag}:', {i})), 1, 8) AS BIGINT) % {span})"


def _ip_sql(i):
    return " || '.' || ".join(_draw_sql(f"ip{n}", i, 1, 254) for n in range(4))


_PERTURBED_SQL = f"""
SELECT c_custkey, 'Oct 21 12:00 gate-south-5 from ' || {_ip_sql(1)} || ' to ' || {_ip_sql(2)} || ' at ' || {_draw_sql('epoch', 1, 1700000000, 100000001)}
  || ' 2025-10-21 21/Oct/2025 10/21- wren WREN ' || c_name AS line FROM (SELECT *, {PERTURB_TEXT} AS x FROM customer)"""


def _digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "sha2(text, 256) AS digest", f"sha2({json_text('text')}, 256) AS json_digest",
        "substring_index(source, '_', -1) AS tail", "upper(lang) AS lang")


_DIGESTS_SQL = """
SELECT doc_id, sha256(text) AS digest, sha256(CAST(to_json(text) AS VARCHAR)) AS json_digest,
  list_last(string_split(source, '_')) AS tail, upper(lang) AS lang FROM documents"""


def _blank(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").selectExpr("doc_id", "explode(split(text, '\\n')) AS raw")
    return drop_blank(lines).groupBy("doc_id").count().selectExpr("doc_id", "count AS n_lines")


_BLANK_SQL = """
SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents)
WHERE regexp_matches(raw, '\\S') GROUP BY doc_id"""


def _catalogue(spark, sf_dir):
    """Schema fields by type, with how many of them a normalized web record fills."""
    from .extraction import normalized
    from .render import WEB
    df = normalized(spark, sf_dir, WEB)
    from pyspark.sql import functions as F
    from ..catalogue import field_catalogue
    from ..operators.quality import field_coverage
    paths = [p for p, t in EVENT_FIELDS.items()]
    filled = field_coverage(df, paths).filter("present > 0").select(F.col("field").alias("path"))
    return (field_catalogue(spark).filter("NOT metadata").join(filled.withColumn("used", F.lit(1)), "path", "left")
            .groupBy("type").agg(F.count("*").alias("fields"), F.coalesce(F.sum("used"), F.lit(0)).alias("filled")))


_TYPES = {}
for _t in EVENT_FIELDS.values():
    _TYPES[_t] = _TYPES.get(_t, 0) + 1
# What a web record fills when every variant occurs in the table.
_WEB_FILLED = {"date": 2, "text": 2, "keyword[]": 4, "keyword": 25, "long": 2, "ip": 1, "ip[]": 1}
_CATALOGUE_SQL = ("SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', CAST({n} AS BIGINT), CAST({_WEB_FILLED.get(t, 0)} AS BIGINT))" for t, n in _TYPES.items())
    + ") AS v(type, fields, filled)")

QUERIES = [
    Query("coerce_timestamp", _timestamps, _TIMESTAMPS_SQL),
    Query("coerce_timestamp_year", _year_guess, _YEAR_GUESS_SQL),
    Query("coerce_duration_ns", _durations, _DURATIONS_SQL),
    Query("coerce_long", _numbers, _NUMBERS_SQL),
    Query("coerce_bool", _booleans, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 4 THEN 1 ELSE 0 END AS flag FROM orders"),
    Query("coerce_ip", _ips, f"SELECT event_id, {_IP_EXPECTED} AS ip FROM events"),
    Query("coerce_arrays", _arrays, _ARRAYS_SQL),
    Query("url_parts", _urls, _URLS_SQL),
    Query("kv_pairs", _pairs, _PAIRS_SQL),
    Query("mask_template", _templates, _TEMPLATES_SQL),
    Query("perturb", _perturbed, _PERTURBED_SQL),
    Query("sha256_json", _digests, _DIGESTS_SQL),
    Query("drop_blank", _blank, _BLANK_SQL),
    Query("field_catalogue", _catalogue, _CATALOGUE_SQL),
]
