"""Envelope, routing, normalization, look-ups, metrics and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import SYSLOG_FACILITY_NAME, SYSLOG_SEVERITY_NAME, SYSLOG_SEVERITY_SCALE, field_catalogue
from ..functions.sql import code_table, text
from ..operators import lookups, pivots, quality, summary
from ..operators.envelope import envelope
from ..operators.normalize import normalize
from ..operators.route import (confidence_filter, missing_specs, normalize_routed, quarantined, route,
                               to_quarantine, union_all)
from ..sources import SOURCES, SourceSpec, extract, flatten_json, source_specs
from ..sources.snort_alert import RULESET
from ..sources.zeek import CONN_STATE
from . import render
from .extraction import normalized
from .query import Query, table
from .render import RECEIVED, RECEIVED_TEXT, RENDERINGS, YEAR, mixed_lines, mixed_sql

_MIXED = mixed_sql()
# What normalization makes of the mixed lines.
_OK = f"(SELECT * FROM ({_MIXED}) WHERE kind IS NULL)"
_BAD = f"(SELECT * FROM ({_MIXED}) WHERE kind IS NOT NULL)"


def routed(spark, sf_dir):
    """The mixed lines, stamped, held against the threshold and routed."""
    lines = envelope(mixed_lines(spark, sf_dir), RECEIVED)
    return route(confidence_filter(lines), source_specs(spark, SOURCES.values()))


# The mixed lines hold three of the sources; the others have no line to parse.
MIXED_SOURCES = {n: SOURCES[n] for n in ("snort_alert", "web_access", "zeek_dns")}


def events(spark, sf_dir):
    return normalize_routed(routed(spark, sf_dir), MIXED_SOURCES, YEAR)


def quarantine(spark, sf_dir):
    return to_quarantine(quarantined(routed(spark, sf_dir), MIXED_SOURCES))


def _envelope(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").selectExpr(
        "concat('/logs/', o_orderstatus, '.log') AS source", "o_orderkey AS seq",
        "concat('order é ', o_orderkey, ' ', o_orderpriority) AS raw")
    return envelope(lines, RECEIVED).select("seq", "event_id", "event_hash", "received_at", "pipeline_version")


_ENVELOPE_SQL = f"""
SELECT seq, sha256('/logs/' || o_orderstatus || '.log:' || seq || ':' || raw) AS event_id, sha256(raw) AS event_hash,
  '{RECEIVED_TEXT}' AS received_at, '1.0.0' AS pipeline_version
FROM (SELECT *, o_orderkey AS seq, 'order é ' || o_orderkey || ' ' || o_orderpriority AS raw FROM orders)"""


def _confidence(spark, sf_dir):
    return confidence_filter(mixed_lines(spark, sf_dir)).select("seq", "log_type", "confidence")


def _route(spark, sf_dir):
    return routed(spark, sf_dir).select("seq", "log_type", "reason")


_ROUTE_SQL = f"""
SELECT seq, log_type, CASE WHEN log_type = 'unknown' THEN 'low_confidence'
  WHEN log_type = 'miscellaneous' THEN 'no_plugin:miscellaneous' END AS reason FROM ({_MIXED})"""


def _quarantine(spark, sf_dir):
    return quarantine(spark, sf_dir).selectExpr(
        "pipeline.ingest.seq AS seq", "error.type AS error_type", "error.message AS error_message",
        "pipeline.classification.log_type AS log_type", "pipeline.classification.confidence AS confidence",
        "array_join(transform(pipeline.classification.candidates, c -> c.label), ',') AS candidates",
        "event.kind AS kind", "event.dataset AS dataset", "log.file.path AS path", "log.source.address AS address",
        "array_join(event.type, ',') AS type", "array_join(event.category, ',') AS category")


_QUARANTINE_SQL = f"""
SELECT seq, kind AS error_type, CASE kind
    WHEN 'low_confidence' THEN 'classifier confidence ' || CAST(round(p1, 4) AS VARCHAR) || ' below threshold 0.6'
    WHEN 'no_plugin' THEN 'miscellaneous'
    ELSE CASE label WHEN 'web_access' THEN 'ValueError:apache combined mismatch'
         WHEN 'snort_alert' THEN 'ValueError:snort fast-format mismatch' ELSE 'JSONDecodeError:invalid JSON' END END AS error_message,
  log_type, round(p1, 4) AS confidence, label || ',syslog' AS candidates, 'pipeline_error' AS kind, 'pipeline.quarantine' AS dataset,
  CASE WHEN src NOT LIKE '%://%' THEN src END AS path, CASE WHEN src LIKE '%://%' THEN src END AS address,
  'error' AS type, 'network' AS category FROM {_BAD}"""

# A source made of expressions whose values often do not coerce.
_STRICT = SourceSpec(
    name="strict", module="acme", dataset="acme.shop.orders", event_category=("database",),
    field_map={"customer": "user.name", "amount": "network.bytes", "peer": "source.ip", "took": "event.duration"},
    fields={
        "customer": "concat('c', raw)", "amount": "CASE WHEN try_cast(raw AS BIGINT) % 3 = 0 THEN '-' ELSE concat(raw, '.9') END",
        "peer": "CASE WHEN try_cast(raw AS BIGINT) % 2 = 0 THEN concat('10.0.0.', try_cast(raw AS BIGINT) % 250) ELSE 'peer' END",
        "took": "CASE WHEN try_cast(raw AS BIGINT) % 5 = 0 THEN 'x:y' ELSE '0:01:00' END",
        "note": "CASE WHEN try_cast(raw AS BIGINT) % 4 = 0 THEN '' ELSE 'kept' END",
        "user.name": "CASE WHEN try_cast(raw AS BIGINT) % 7 = 0 THEN concat('later', raw) END",
    })


def _map_fields(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").selectExpr("'o.log' AS source", "o_orderkey AS seq", "cast(o_orderkey AS STRING) AS raw")
    return normalize(envelope(lines, RECEIVED), _STRICT, YEAR).selectExpr(
        "pipeline.ingest.seq AS seq", "user.name AS user_name", "network.bytes AS bytes", "source.ip AS ip", "event.duration AS ns",
        "array_join(sort_array(map_keys(unmapped)), ',') AS kept", "try_element_at(unmapped, 'peer') AS peer", "residual_ns")


_MAP_FIELDS_SQL = """
SELECT k AS seq, CASE WHEN k % 7 = 0 THEN 'later' || k ELSE 'c' || k END AS user_name,
  CASE WHEN k % 3 > 0 THEN k END AS bytes, CASE WHEN k % 2 = 0 THEN '10.0.0.' || (k % 250) END AS ip,
  CASE WHEN k % 5 > 0 THEN 60000000000 END AS ns,
  concat_ws(',', CASE WHEN k % 3 = 0 THEN 'amount' END, CASE WHEN k % 4 > 0 THEN 'note' END,
            CASE WHEN k % 2 > 0 THEN 'peer' END, CASE WHEN k % 5 = 0 THEN 'took' END) AS kept,
  CASE WHEN k % 2 > 0 THEN '"peer"' END AS peer, 'acme.shop.orders' AS residual_ns
FROM (SELECT o_orderkey AS k FROM orders)"""


def _drop_empty(spark, sf_dir):
    spec = SourceSpec(name="sparse", fields={
        "a": "CASE WHEN try_cast(raw AS BIGINT) % 2 = 0 THEN '' ELSE raw END", "zero": "0L", "no": "false",
        "none": "array()", "null": "cast(null AS STRING)"})
    lines = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS STRING) AS raw")
    return extract(lines, spec).selectExpr("raw", "array_join(sort_array(map_keys(unmapped)), ',') AS kept")


def _origin(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(
        "pipeline.ingest.seq AS seq", "event.ingested AS ingested", "log.file.path AS path", "log.source.address AS address",
        "event.hash = sha2(event.original, 256) AS hash_ok",
        "event.id = sha2(concat_ws(':', pipeline.ingest.source, cast(pipeline.ingest.seq AS STRING), event.original), 256) AS id_ok",
        "`@timestamp` IS NOT NULL AS dated")


_ORIGIN_SQL = f"""
SELECT seq, '{RECEIVED_TEXT}' AS ingested, CASE WHEN src NOT LIKE '%://%' THEN src END AS path,
  CASE WHEN src LIKE '%://%' THEN src END AS address, true AS hash_ok, true AS id_ok, true AS dated FROM {_OK}"""


def _defaults(spark, sf_dir):
    return (events(spark, sf_dir).selectExpr(
        "event.kind AS kind", "array_join(event.category, ',') AS category", "event.outcome AS outcome",
        "event.module AS module", "event.dataset AS dataset", "event.provider AS provider")
        .groupBy("kind", "category", "outcome", "module", "dataset", "provider").agg(F.count("*").alias("n")))


_WEB_CODE = render.WEB.facts["code"]
_DNS_RCODE = render.DNS.facts["rcode"]
_DEFAULTS_SQL = f"""
SELECT CASE label WHEN 'snort_alert' THEN 'alert' ELSE 'event' END AS kind,
  CASE label WHEN 'snort_alert' THEN 'intrusion_detection' WHEN 'web_access' THEN 'web' ELSE 'network' END AS category,
  CASE label WHEN 'snort_alert' THEN 'unknown' WHEN 'web_access' THEN CASE WHEN {_WEB_CODE} < 400 THEN 'success' ELSE 'failure' END
    ELSE CASE WHEN {_DNS_RCODE} = 'NOERROR' THEN 'success' WHEN {_DNS_RCODE} IS NULL THEN 'unknown' ELSE 'failure' END END AS outcome,
  CASE label WHEN 'snort_alert' THEN 'snort' WHEN 'web_access' THEN 'apache' ELSE 'zeek' END AS module,
  CASE label WHEN 'snort_alert' THEN 'snort.alert' WHEN 'web_access' THEN 'apache.access' ELSE 'zeek.dns' END AS dataset,
  CASE label WHEN 'snort_alert' THEN 'snort' WHEN 'web_access' THEN 'apache' ELSE 'zeek' END AS provider,
  count(*) AS n FROM {_OK} GROUP BY 1, 2, 3, 4, 5, 6"""


def _observer(spark, sf_dir):
    return (events(spark, sf_dir).selectExpr("observer.vendor AS vendor", "observer.product AS product", "observer.type AS type")
            .groupBy("vendor", "product", "type").agg(F.count("*").alias("n")))


_OBSERVER_SQL = f"""
SELECT CASE label WHEN 'snort_alert' THEN 'Snort' WHEN 'web_access' THEN 'Apache' ELSE 'Zeek' END AS vendor,
  CASE label WHEN 'snort_alert' THEN 'Snort' WHEN 'web_access' THEN 'httpd' ELSE 'Zeek' END AS product,
  CASE label WHEN 'web_access' THEN 'web-server' ELSE 'ids' END AS type, count(*) AS n FROM {_OK} GROUP BY 1, 2, 3"""


def _severity(spark, sf_dir):
    """The scale as a join over all orders, and as the expression the sources run: an unknown code stays as it is."""
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 10 AS severity")
    scale = lookups.code_frame(spark, SYSLOG_SEVERITY_SCALE, value_type="bigint")
    joined = lookups.lookup(df, "severity", scale, "normalized", "severity")
    return joined.selectExpr("*", f"cast(coalesce({code_table(SYSLOG_SEVERITY_SCALE, 'severity')}, severity) AS BIGINT) AS in_source")


_SEVERITY_SQL = """
SELECT o_orderkey, severity, n AS normalized, n AS in_source FROM (
  SELECT o_orderkey, o_custkey % 10 AS severity, CAST(CASE o_custkey % 10 WHEN 0 THEN 10 WHEN 1 THEN 9 WHEN 2 THEN 8 WHEN 3 THEN 7
    WHEN 4 THEN 5 WHEN 5 THEN 4 WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE o_custkey % 10 END AS BIGINT) AS n FROM orders)"""


def _names(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 200 AS pri")
    df = df.selectExpr("o_orderkey", "pri div 8 AS facility_code", "pri % 8 AS severity_code")
    df = lookups.lookup(df, "facility_code", lookups.code_frame(spark, SYSLOG_FACILITY_NAME), "facility")
    return lookups.lookup(df, "severity_code", lookups.code_frame(spark, SYSLOG_SEVERITY_NAME), "severity")


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NAMES_SQL = f"""
SELECT o_orderkey, f AS facility_code, s AS severity_code, {_sql_list(SYSLOG_FACILITY_NAME.values())}[f + 1] AS facility,
  {_sql_list(SYSLOG_SEVERITY_NAME.values())}[s + 1] AS severity
FROM (SELECT o_orderkey, CAST(floor((o_custkey % 200) / 8) AS BIGINT) AS f, o_custkey % 200 % 8 AS s FROM orders)"""


def _conn_state(spark, sf_dir):
    """Event type and outcome by connection state: as joins, and as the source places them in its documents."""
    df = table(spark, sf_dir, "lineitem").selectExpr(f"coalesce({RENDERINGS['zeek_conn'].facts['state']}, 'none') AS state")
    counted = df.groupBy("state").agg(F.count("*").alias("n"))
    for k, (column, default) in enumerate((("last_type", None), ("outcome", "'unknown'"))):
        codes = lookups.code_frame(spark, {code: v[k] for code, v in CONN_STATE.items()}, "string")
        counted = lookups.lookup(counted, "state", codes, column, default)
    joined = counted.selectExpr("state", "n", "concat_ws(',', 'connection', last_type) AS type", "outcome")
    docs = normalized(spark, sf_dir, RENDERINGS["zeek_conn"]).selectExpr(
        "coalesce(get_json_object(unmapped['conn_state'], '$'), 'none') AS state", "array_join(event.type, ',') AS doc_type", "event.outcome AS doc_outcome")
    placed = docs.groupBy("state").agg(F.count("*").alias("parsed"), F.min("doc_type").alias("doc_type"), F.max("doc_outcome").alias("doc_outcome"))
    return joined.join(placed, "state", "left")


_CONN_STATE_SQL = f"""
WITH s AS (SELECT coalesce(state, 'none') AS state, broken FROM ({RENDERINGS['zeek_conn'].facts_sql()})),
  c AS (SELECT state, count(*) AS n, nullif(count(*) FILTER (NOT broken), 0) AS parsed FROM s GROUP BY state),
  t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', 'connection,{v[0]}', '{v[1]}')" for k, v in CONN_STATE.items())}) AS t(code, type, outcome)),
  j AS (SELECT state, n, parsed, coalesce(type, 'connection') AS type, coalesce(outcome, 'unknown') AS outcome FROM c LEFT JOIN t ON state = code)
SELECT state, n, type, outcome, parsed, CASE WHEN parsed > 0 THEN type END AS doc_type, CASE WHEN parsed > 0 THEN outcome END AS doc_outcome FROM j"""


def _ruleset(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"cast({RENDERINGS['snort_alert'].facts['gid']} AS STRING) AS gid")
    return lookups.lookup(df, "gid", lookups.code_frame(spark, RULESET, "string"), "ruleset", "concat('gid-', gid)")


_RULESET_SQL = f"""
SELECT event_id, gid, CASE gid WHEN '1' THEN 'snort' WHEN '3' THEN 'snort-so' WHEN '119' THEN 'http_inspect'
  WHEN '129' THEN 'stream5' ELSE 'gid-' || gid END AS ruleset
FROM (SELECT event_id, CAST({RENDERINGS['snort_alert'].facts['gid']} AS VARCHAR) AS gid FROM events)"""


def _cases(spark, sf_dir):
    """Transports, protocols, directions and methods after the case rules, by source."""
    parts = []
    for n in ("zeek_conn", "zeek_http", "cisco_asa"):
        parts.append(normalized(spark, sf_dir, RENDERINGS[n]).selectExpr(
            f"'{n}' AS log_type", "network.transport AS transport", "network.direction AS direction",
            "http.request.method AS method"))
    return union_all(parts).groupBy("log_type", "transport", "direction", "method").agg(F.count("*").alias("n"))


_DIRECTION_SQL = ("CASE WHEN lr IS NOT NULL THEN CASE WHEN lo THEN CASE WHEN lr THEN 'internal' ELSE 'outbound' END "
                  "ELSE CASE WHEN lr THEN 'inbound' ELSE 'external' END END END")
_CASES_SQL = f"""
SELECT log_type, transport, direction, method, count(*) AS n FROM (
  SELECT 'zeek_conn' AS log_type, proto AS transport, {_DIRECTION_SQL} AS direction, NULL AS method FROM ({RENDERINGS['zeek_conn'].facts_sql()}) WHERE NOT broken
  UNION ALL SELECT 'zeek_http', 'tcp', NULL, CASE WHEN form = 'tunnel' THEN 'CONNECT' ELSE 'GET' END FROM ({RENDERINGS['zeek_http'].facts_sql()}) WHERE NOT broken
  UNION ALL SELECT 'cisco_asa', CASE kind WHEN 'icmp' THEN 'icmp' WHEN 'other' THEN NULL ELSE proto END,
    CASE WHEN kind = 'built' THEN CASE WHEN inbound THEN 'inbound' ELSE 'outbound' END WHEN kind = 'icmp' AND inbound THEN 'inbound' END, NULL
    FROM ({RENDERINGS['cisco_asa'].facts_sql()}) WHERE NOT broken) GROUP BY ALL"""


def _related(spark, sf_dir):
    return normalized(spark, sf_dir, RENDERINGS["syslog"]).selectExpr(
        "pipeline.ingest.seq AS seq", *[f"array_join(related.{k}, ',') AS {k}" for k in ("ip", "user", "hosts")])


_RELATED_SQL = f"""
SELECT seq, CASE kind WHEN 'firewall' THEN list_aggregate(list_sort([sip, dip]), 'string_agg', ',')
    WHEN 'login' THEN sip WHEN 'no_login' THEN sip END AS ip,
  CASE WHEN kind = 'sudo' OR (kind = 'session' AND opened) THEN list_aggregate(list_sort([who, 'root']), 'string_agg', ',')
    WHEN kind IN ('session', 'login', 'no_login') THEN who END AS user,
  'HOST-' || (o_custkey % 9) AS hosts FROM ({RENDERINGS['syslog'].facts_sql()}) WHERE NOT broken"""


def _residual(spark, sf_dir):
    parts = [normalized(spark, sf_dir, r).selectExpr("log_type", "residual_ns", "explode_outer(map_keys(unmapped)) AS key")
             for n, r in RENDERINGS.items() if n in ("snort_alert", "proxy_access", "zeek_dns", "web_access")]
    return union_all(parts).groupBy("log_type", "residual_ns", "key").agg(F.count("*").alias("n"))


_RESIDUAL_SQL = f"""
WITH s AS ({RENDERINGS['snort_alert'].facts_sql()}), p AS ({RENDERINGS['proxy_access'].facts_sql()}),
  d AS ({RENDERINGS['zeek_dns'].facts_sql()}), w AS ({RENDERINGS['web_access'].facts_sql()})
SELECT log_type, residual_ns, key, count(*) AS n FROM (
  SELECT 'snort_alert' AS log_type, 'snort.alert' AS residual_ns, unnest(['gid', 'priority']) AS key FROM s WHERE NOT broken
  UNION ALL SELECT 'proxy_access', 'squid.access', CASE WHEN listed THEN 'ssl_bump' END FROM p WHERE NOT broken AND NOT bad_count
  UNION ALL SELECT 'zeek_dns', 'zeek.dns', unnest(CASE WHEN answers > 0 THEN ['TTLs', 'uid'] ELSE ['uid'] END) FROM d WHERE NOT broken
  UNION ALL SELECT 'web_access', 'apache.access', NULL FROM w WHERE NOT broken) GROUP BY ALL"""


def _metadata(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(
        "pipeline.ingest.seq AS seq", "pipeline.ingest.source AS source", "pipeline.schema.version AS schema_version",
        "pipeline.pipeline.version AS pipeline_version", "pipeline.parser.name AS parser", "pipeline.parser.version AS parser_version",
        "pipeline.classification.log_type AS log_type", "pipeline.classification.confidence AS confidence")


_METADATA_SQL = f"""
SELECT seq, src AS source, '1.0' AS schema_version, '1.0.0' AS pipeline_version, label AS parser, '2.0' AS parser_version,
  label AS log_type, round(p1, 4) AS confidence FROM {_OK}"""


def _nest(spark, sf_dir):
    """Documents as JSON text, read by path: nesting, and no trace of absent fields."""
    from ..sources.sinks import document_json
    doc = document_json(events(spark, sf_dir))
    return doc.selectExpr(
        "cast(get_json_object(value, '$.pipeline.ingest.seq') AS BIGINT) AS seq",
        "get_json_object(value, '$.event.dataset') AS dataset", "get_json_object(value, '$.network.transport') AS transport",
        "get_json_object(value, '$.source.ip') AS ip", "instr(value, '{}') > 0 AS has_empty",
        "get_json_object(value, '$.snort.alert.priority') AS priority", "get_json_object(value, '$.zeek.dns.uid') AS uid",
        "instr(value, 'null') > 0 AS has_null")


_NEST_SQL = f"""
SELECT seq, CASE label WHEN 'snort_alert' THEN 'snort.alert' WHEN 'web_access' THEN 'apache.access' ELSE 'zeek.dns' END AS dataset,
  CASE label WHEN 'web_access' THEN 'tcp' WHEN 'zeek_dns' THEN 'udp' ELSE lower({render.SNORT.facts['proto']}) END AS transport,
  CASE label WHEN 'web_access' THEN {render.WEB.facts['ip']} WHEN 'zeek_dns' THEN '198.18.10.' || (user_id % 250) ELSE {render.SNORT.facts['sip']} END AS ip,
  false AS has_empty, CASE WHEN label = 'snort_alert' THEN CAST(event_id % 4 + 1 AS VARCHAR) END AS priority,
  CASE WHEN label = 'zeek_dns' THEN 'C' || event_id END AS uid, false AS has_null FROM {_OK}"""


def _pivot(spark, sf_dir):
    every = union_all([normalized(spark, sf_dir, RENDERINGS[n]) for n in ("web_access", "syslog", "proxy_access")])
    return pivots.pivot_lookup(every, "user")


_PIVOT_SQL = f"""
SELECT value, count(*) AS n, count(DISTINCT t) AS n_types, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM (
  SELECT 'web_access' AS t, who AS value FROM ({RENDERINGS['web_access'].facts_sql()}) WHERE NOT broken
  UNION ALL SELECT 'proxy_access', who FROM ({RENDERINGS['proxy_access'].facts_sql()}) WHERE NOT broken AND NOT bad_count
  UNION ALL SELECT 'syslog', unnest(CASE WHEN kind = 'sudo' OR (kind = 'session' AND opened) THEN ['root', who]
    WHEN kind IN ('session', 'login', 'no_login') THEN [who] ELSE [] END) FROM ({RENDERINGS['syslog'].facts_sql()}) WHERE NOT broken)
WHERE value IS NOT NULL GROUP BY value"""


def _spec_join(spark, sf_dir):
    known = source_specs(spark, SOURCES.values()).select("log_type", "dataset")
    typed = confidence_filter(mixed_lines(spark, sf_dir)).select("seq", "log_type")
    return typed.join(F.broadcast(known), "log_type", "left").select("seq", "log_type", "dataset")


_SPEC_JOIN_SQL = f"""
SELECT seq, log_type, CASE log_type WHEN 'snort_alert' THEN 'snort.alert' WHEN 'web_access' THEN 'apache.access'
  WHEN 'zeek_dns' THEN 'zeek.dns' END AS dataset FROM ({_MIXED})"""


def _missing(spark, sf_dir):
    labels = mixed_lines(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return missing_specs(labels, source_specs(spark, SOURCES.values()))


def _summary(spark, sf_dir):
    return summary.run_summary(events(spark, sf_dir).select("log_type"), quarantine(spark, sf_dir).select("reason"))


_SUMMARY_SQL = f"""
SELECT count(*) AS events_total, count(*) FILTER (kind IS NULL) AS normalized, count(*) FILTER (kind IS NOT NULL) AS quarantined,
  round(count(*) FILTER (kind IS NULL) / count(*), 4) AS success_rate FROM ({_MIXED})"""


def _share(spark, sf_dir):
    return summary.type_share(events(spark, sf_dir), mixed_lines(spark, sf_dir))


_SHARE_SQL = f"""
SELECT label AS log_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 4) AS share_pct,
  (SELECT count(DISTINCT label) FROM {_OK}) AS n_types FROM {_OK} GROUP BY label ORDER BY n DESC, log_type"""


def _union(spark, sf_dir):
    """All eight sources in one table."""
    return union_all([normalized(spark, sf_dir, r) for r in RENDERINGS.values()]).groupBy("log_type", "residual_ns").agg(
        F.count("*").alias("n"), F.count("source.ip").alias("with_source"), F.count("event_ts").alias("with_time"))


def _union_sql():
    from .extraction import FAILURE
    source_ip = {"cisco_asa": "kind <> 'other'", "syslog": "kind IN ('firewall', 'login', 'no_login')"}
    parts = [f"SELECT '{n}' AS log_type, '{SOURCES[n].residual_namespace}' AS residual_ns, count(*) AS n, "
             f"count(*) FILTER ({source_ip.get(n, 'true')}) AS with_source, count(*) AS with_time "
             f"FROM ({r.facts_sql()}) WHERE NOT ({FAILURE[n][0]})" for n, r in RENDERINGS.items()]
    return " UNION ALL ".join(parts)


def _conservation(spark, sf_dir):
    df = routed(spark, sf_dir)
    return quality.conservation(df, normalize_routed(df, MIXED_SOURCES, YEAR).selectExpr("event.id AS event_id"),
                                quarantined(df, MIXED_SOURCES).select("event_id"))


_CONSERVATION_SQL = f"""
SELECT count(*) AS events, count(*) FILTER (kind IS NULL) AS normalized, count(*) FILTER (kind IS NOT NULL) AS quarantined,
  CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS invented, CAST(0 AS BIGINT) AS in_both FROM ({_MIXED})"""


def _audit(spark, sf_dir):
    return quality.traceability_audit(events(spark, sf_dir), quarantine(spark, sf_dir))


_ZERO = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("bad_id", "bad_hash", "no_raw", "bad_record"))
_AUDIT_SQL = f"""
SELECT CASE WHEN kind IS NULL THEN 'normalized' ELSE 'quarantine' END AS record, count(*) AS records, {_ZERO}
FROM ({_MIXED}) GROUP BY 1"""


def _vocab(spark, sf_dir):
    """Words outside the vocabulary: all of one source's kinds are, when its definition names none that are allowed."""
    odd = SOURCES["web_access"].with_changes(event_kind="visit", event_category=("web", "shop"))
    lines = envelope(RENDERINGS["web_access"].lines(spark, sf_dir), RECEIVED)
    return quality.vocab_check(normalize(lines, odd, YEAR))


_VOCAB_SQL = f"""
SELECT * FROM (VALUES ('event.kind', 'visit'), ('event.category', 'shop')) AS v(field, value),
  (SELECT count(*) AS n FROM ({RENDERINGS['web_access'].facts_sql()}) WHERE NOT broken)"""


def _validation(spark, sf_dir):
    """Faulty definitions, weighed by the lines their source would have taken."""
    bad = [SOURCES["web_access"].with_changes(event_type=("access", "seen")),
           SOURCES["zeek_dns"].with_changes(field_map={"ts": "@timestamp", "query": "dns.name"}), SOURCES["snort_alert"]]
    faults = quality.validate_specs(source_specs(spark, bad), field_catalogue(spark))
    lines = mixed_lines(spark, sf_dir).groupBy(F.col("label").alias("log_type")).agg(F.count("*").alias("n_lines"))
    return lines.join(F.broadcast(faults), "log_type")


_VALIDATION_SQL = f"""
SELECT label AS log_type, field, v.value AS value, count(*) AS n_lines FROM ({_MIXED}) JOIN
  (VALUES ('web_access', 'event.type', 'seen'), ('zeek_dns', 'field_map', 'dns.name')) AS v(t, field, value) ON label = t
GROUP BY 1, 2, 3"""


def _self_test(spark, sf_dir):
    parts = [r.lines(spark, sf_dir).selectExpr(f"{text(n)} AS log_type", "raw") for n, r in RENDERINGS.items()]
    return quality.self_test(union_all(parts), SOURCES)


def _self_test_sql():
    from .extraction import FAILURE
    return " UNION ALL ".join(
        f"SELECT '{n}' AS log_type, count(*) AS n, count(*) FILTER ({FAILURE[n][0]}) AS failed, "
        f"min(CASE WHEN {FAILURE[n][0]} THEN {FAILURE[n][1]} END) AS first_error FROM ({r.facts_sql()})"
        for n, r in RENDERINGS.items())


_COVERED = ("source.ip", "source.port", "url.domain", "user.name", "rule.category")


def _coverage(spark, sf_dir):
    every = union_all([normalized(spark, sf_dir, RENDERINGS[n]) for n in ("web_access", "snort_alert")])
    return quality.field_coverage(every, list(_COVERED))


_COVERAGE_SQL = f"""
WITH w AS (SELECT * FROM ({RENDERINGS['web_access'].facts_sql()}) WHERE NOT broken),
  s AS (SELECT * FROM ({RENDERINGS['snort_alert'].facts_sql()}) WHERE NOT broken),
  c AS (SELECT 'web_access' AS log_type, count(*) AS n, unnest([{', '.join(f"'{p}'" for p in _COVERED)}]) AS field,
          unnest([count(ip), 0, count(CASE WHEN absolute THEN 1 END), count(who), 0]) AS present FROM w
        UNION ALL SELECT 'snort_alert', count(*), unnest([{', '.join(f"'{p}'" for p in _COVERED)}]),
          unnest([count(sip), count(sport), 0, 0, count(class)]) FROM s)
SELECT log_type, field, CAST(present AS BIGINT) AS present, round(present / n, 4) AS share FROM c"""


def _residual_keys(spark, sf_dir):
    return quality.residual_keys(normalized(spark, sf_dir, RENDERINGS["zeek_conn"]))


_RESIDUAL_KEYS_SQL = f"""
SELECT 'zeek_conn' AS log_type, key, count(*) AS n FROM (
  SELECT unnest(list_concat(['history', 'local_orig', 'tags.q', 'tags.line.no'], list_concat(
    CASE WHEN state IS NULL THEN [] ELSE ['conn_state'] END, list_concat(CASE WHEN zone IS NULL THEN [] ELSE ['source.nat.port'] END, CASE WHEN lr IS NULL THEN [] ELSE ['local_resp'] END)))) AS key
  FROM ({RENDERINGS['zeek_conn'].facts_sql()}) WHERE NOT broken) GROUP BY 1, 2"""


def _flatten(spark, sf_dir):
    return (flatten_json(RENDERINGS["zeek_conn"].lines(spark, sf_dir)).filter("flat IS NOT NULL")
            .selectExpr("seq", "flat['id.orig_h'] AS host", "flat['tags.line.no'] AS line_no", "flat['duration'] AS duration",
                        "cast(size(flat) AS BIGINT) AS n_keys"))


_FLATTEN_SQL = f"""
SELECT seq, '"' || oh || '"' AS host, CAST(l_linenumber AS VARCHAR) AS line_no,
  CASE WHEN ms % 1000 = 0 THEN CAST(CAST(ms // 1000 AS BIGINT) AS VARCHAR)
    ELSE rtrim(CAST(ms // 1000 AS VARCHAR) || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0'), '0') END AS duration,
  CAST(12 + CASE WHEN ob IS NULL THEN 0 ELSE 1 END + CASE WHEN rb IS NULL THEN 0 ELSE 1 END + CASE WHEN state IS NULL THEN 0 ELSE 1 END
    + CASE WHEN lr IS NULL THEN 0 ELSE 1 END + CASE WHEN who IS NULL THEN 0 ELSE 1 END + CASE WHEN zone IS NULL THEN 0 ELSE 2 END AS BIGINT) AS n_keys
FROM ({RENDERINGS['zeek_conn'].facts_sql()}) WHERE NOT broken"""


def _parse_ticket(raw: str) -> dict:
    """A user's own format: ``status|customer|priority``; anything else fails."""
    status, customer, priority = raw.split("|")
    if status == "F":
        raise ValueError("closed")
    return {"user.name": customer, "event.severity": int(priority[0]), "status": status, "event.type": ["info", "change"]}


def _custom(spark, sf_dir):
    from ..sources import custom_source
    spec = custom_source(_parse_ticket, name="tickets", module="desk", severity_map={1: 9})
    lines = table(spark, sf_dir, "orders").selectExpr(
        "'t.log' AS source", "o_orderkey AS seq", "concat(o_orderstatus, '|c', o_custkey, '|', o_orderpriority) AS raw")
    fields = extract(lines, spec)
    ok = normalize(envelope(lines, RECEIVED), spec, YEAR)
    good = ok.selectExpr("pipeline.ingest.seq AS seq", "user.name AS user_name", "event.severity AS severity",
                         "unmapped['status'] AS status", "array_join(event.type, ',') AS type", "cast(null AS STRING) AS error")
    bad = fields.filter("parse_error IS NOT NULL").selectExpr(
        "seq", "cast(null AS STRING) AS user_name", "cast(null AS BIGINT) AS severity", "cast(null AS STRING) AS status",
        "cast(null AS STRING) AS type", "parse_error AS error")
    return good.unionByName(bad)


_CUSTOM_SQL = """
SELECT o_orderkey AS seq, CASE WHEN o_orderstatus <> 'F' THEN 'c' || o_custkey END AS user_name,
  CASE WHEN o_orderstatus <> 'F' THEN CAST(CASE WHEN o_orderpriority LIKE '1%' THEN 9 ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) END AS BIGINT) END AS severity,
  CASE WHEN o_orderstatus <> 'F' THEN '"' || o_orderstatus || '"' END AS status,
  CASE WHEN o_orderstatus <> 'F' THEN 'info,change' END AS type,
  CASE WHEN o_orderstatus = 'F' THEN 'ValueError:closed' END AS error FROM orders"""

QUERIES = [
    Query("envelope", _envelope, _ENVELOPE_SQL),
    Query("confidence_filter", _confidence, f"SELECT seq, log_type, round(p1, 4) AS confidence FROM ({_MIXED})"),
    Query("route", _route, _ROUTE_SQL),
    Query("quarantine_project", _quarantine, _QUARANTINE_SQL),
    Query("drop_empty", _drop_empty, "SELECT CAST(o_orderkey AS VARCHAR) AS raw, CASE WHEN o_orderkey % 2 = 0 THEN 'no,none,zero' ELSE 'a,no,none,zero' END AS kept FROM orders"),
    Query("map_fields", _map_fields, _MAP_FIELDS_SQL),
    Query("nest", _nest, _NEST_SQL),
    Query("origin_fields", _origin, _ORIGIN_SQL),
    Query("defaults", _defaults, _DEFAULTS_SQL),
    Query("observer_defaults", _observer, _OBSERVER_SQL),
    Query("severity_norm", _severity, _SEVERITY_SQL),
    Query("facility_join", _names, _NAMES_SQL),
    Query("conn_state_join", _conn_state, _CONN_STATE_SQL),
    Query("ruleset_join", _ruleset, _RULESET_SQL),
    Query("case_norm", _cases, _CASES_SQL),
    Query("related_pivots", _related, _RELATED_SQL),
    Query("residual_namespace", _residual, _RESIDUAL_SQL),
    Query("stamp_metadata", _metadata, _METADATA_SQL),
    Query("pivot_lookup", _pivot, _PIVOT_SQL),
    Query("spec_join", _spec_join, _SPEC_JOIN_SQL),
    Query("missing_specs", _missing, f"SELECT label, count(*) AS n FROM ({_MIXED}) WHERE label = 'miscellaneous' GROUP BY label"),
    Query("run_summary", _summary, _SUMMARY_SQL),
    Query("per_type_ok", lambda s, d: summary.count_by(events(s, d), "log_type"),
          f"SELECT label AS log_type, count(*) AS n FROM {_OK} GROUP BY label"),
    Query("quarantine_by_reason", lambda s, d: summary.quarantine_by_reason(quarantine(s, d)),
          f"SELECT kind, count(*) AS n FROM {_BAD} GROUP BY kind"),
    Query("quarantine_by_type", lambda s, d: summary.quarantine_by_type(quarantine(s, d)),
          f"SELECT log_type, count(*) AS n FROM {_BAD} GROUP BY log_type"),
    Query("type_share", _share, _SHARE_SQL),
    Query("union_sources", _union, _union_sql()),
    Query("conservation_check", _conservation, _CONSERVATION_SQL),
    Query("traceability_audit", _audit, _AUDIT_SQL),
    Query("vocab_check", _vocab, _VOCAB_SQL),
    Query("spec_validation", _validation, _VALIDATION_SQL),
    Query("source_self_test", _self_test, _self_test_sql()),
    Query("field_coverage", _coverage, _COVERAGE_SQL),
    Query("residual_keys", _residual_keys, _RESIDUAL_KEYS_SQL),
    Query("flatten_json", _flatten, _FLATTEN_SQL),
    Query("custom_source", _custom, _CUSTOM_SQL),
]
