"""Extraction queries: rendered lines, extracted and normalized, against the facts they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.envelope import envelope
from ..operators.normalize import normalize
from ..operators.route import parse_failures
from ..session import configure
from ..sources import SOURCES
from . import render
from .render import RECEIVED, YEAR, Rendering


def normalized(spark: SparkSession, sf_dir: str, r: Rendering) -> DataFrame:
    lines = envelope(r.lines(spark, sf_dir), RECEIVED)
    return normalize(lines, SOURCES[r.log_type], YEAR)


def failures(spark: SparkSession, sf_dir: str, r: Rendering) -> DataFrame:
    return parse_failures(r.lines(spark, sf_dir), SOURCES[r.log_type])


def _join(x):
    return f"array_join({x}, ',')"


# Per source: output column -> (SQL over the document, DuckDB SQL over the facts).
# An array is compared as its members joined by commas.
_ISO_LOG = "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.000+00:00')"

EXPECTED: dict[str, dict[str, tuple[str, str]]] = {
    "web_access": {
        "seq": ("pipeline.ingest.seq", "seq"),
        "ts": ("`@timestamp`", _ISO_LOG),
        "ip": ("source.ip", "ip"),
        "user_name": ("user.name", "who"),
        "method": ("http.request.method", "verb"),
        "version": ("http.version", "concat('1.', event_id % 2)"),
        "status": ("http.response.status_code", "CAST(code AS BIGINT)"),
        "bytes": ("http.response.body.bytes", "size"),
        "referrer": ("http.request.referrer", "ref"),
        "agent": ("user_agent.original", "'Mozilla/5.0 (X11; Linux x86_64)'"),
        "path": ("url.path", "path"),
        "query": ("url.query", "query"),
        "domain": ("url.domain", "CASE WHEN absolute THEN 'shop.example.com' END"),
        "scheme": ("url.scheme", "CASE WHEN absolute THEN 'http' END"),
        "event_type": (_join("event.type"), "CASE WHEN code = 403 THEN 'access,denied' WHEN code >= 500 THEN 'access,error' ELSE 'access' END"),
        "outcome": ("event.outcome", "CASE WHEN code < 400 THEN 'success' ELSE 'failure' END"),
        "dataset": ("event.dataset", "'apache.access'"),
        "related_user": (_join("related.user"), "who"),
        "related_hosts": (_join("related.hosts"), "CASE WHEN absolute THEN 'shop.example.com' END"),
    },
    "snort_alert": {
        "seq": ("pipeline.ingest.seq", "seq"),
        "ts": ("`@timestamp`", "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(CAST(floor(microsecond(ts) % 1000000 / 1000) AS BIGINT) AS VARCHAR), 3, '0'), '+00:00')"),
        "rule": ("rule.name", "title"),
        "sid": ("rule.id", "CAST(sid AS VARCHAR)"),
        "code": ("event.code", "CAST(sid AS VARCHAR)"),
        "rev": ("rule.version", "CAST(rev AS VARCHAR)"),
        "ruleset": ("rule.ruleset", "CASE gid WHEN 1 THEN 'snort' WHEN 3 THEN 'snort-so' WHEN 119 THEN 'http_inspect' WHEN 129 THEN 'stream5' ELSE 'gid-7' END"),
        "category": ("rule.category", "class"),
        "severity": ("event.severity", "CAST(CASE prio WHEN 1 THEN 9 WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 1 END AS BIGINT)"),
        "kind": ("event.kind", "'alert'"),
        "transport": ("network.transport", "lower(proto)"),
        "sip": ("source.ip", "sip"),
        "sport": ("source.port", "CAST(sport AS BIGINT)"),
        "dip": ("destination.ip", "dip"),
        "dport": ("destination.port", "CAST(dport AS BIGINT)"),
        "gid": ("unmapped['gid']", "concat('\"', gid, '\"')"),
        "priority": ("unmapped['priority']", "CAST(prio AS VARCHAR)"),
        "related_ip": (_join("related.ip"), "concat(sip, ',', dip)"),
    },
    "cisco_asa": {
        "seq": ("pipeline.ingest.seq", "seq"),
        "ts": ("`@timestamp`", "concat('2024', strftime(l_shipdate, '-%m-%dT'), lpad(CAST(h AS VARCHAR), 2, '0'), ':', lpad(CAST(m AS VARCHAR), 2, '0'), ':', lpad(CAST(s AS VARCHAR), 2, '0'), '.000+00:00')"),
        "action": ("event.action", "CASE kind WHEN 'icmp' THEN CASE WHEN inbound THEN 'built' ELSE 'teardown' END WHEN 'other' THEN NULL ELSE kind END"),
        "event_type": (_join("event.type"), "CASE WHEN kind = 'built' OR (kind = 'icmp' AND inbound) THEN 'connection,start' WHEN kind = 'deny' THEN 'connection,denied' WHEN kind = 'other' THEN 'info' ELSE 'connection,end' END"),
        "outcome": ("event.outcome", "CASE kind WHEN 'deny' THEN 'failure' WHEN 'other' THEN 'unknown' ELSE 'success' END"),
        "severity": ("event.severity", "CAST(CASE sev WHEN 0 THEN 10 WHEN 1 THEN 9 WHEN 2 THEN 8 WHEN 3 THEN 7 WHEN 4 THEN 5 WHEN 5 THEN 4 WHEN 6 THEN 2 ELSE 1 END AS BIGINT)"),
        "severity_name": ("log.syslog.severity.name", "['emergency','alert','critical','error','warning','notice','informational','debug'][sev + 1]"),
        "facility": ("log.syslog.facility.name", "'local4'"),
        "priority": ("log.syslog.priority", "CAST(160 + sev AS BIGINT)"),
        "host_name": ("host.name", "concat('FW-', l_suppkey % 5)"),
        "transport": ("network.transport", "CASE kind WHEN 'icmp' THEN 'icmp' WHEN 'other' THEN NULL ELSE proto END"),
        "direction": ("network.direction", "CASE WHEN kind = 'built' THEN CASE WHEN inbound THEN 'inbound' ELSE 'outbound' END WHEN kind = 'icmp' AND inbound THEN 'inbound' END"),
        "sip": ("source.ip", "CASE WHEN kind <> 'other' THEN sip END"),
        "sport": ("source.port", "CASE WHEN kind NOT IN ('other', 'icmp') THEN sport END"),
        "snat": ("source.nat.ip", "CASE WHEN kind = 'built' THEN sip END"),
        "dip": ("destination.ip", "CASE WHEN kind <> 'other' THEN dip END"),
        "dport": ("destination.port", "CASE WHEN kind NOT IN ('other', 'icmp') THEN dport END"),
        "dnat": ("destination.nat.ip", "CASE WHEN kind IN ('built', 'icmp') THEN nip END"),
        "dnat_port": ("destination.nat.port", "CASE WHEN kind = 'built' THEN dport END"),
        "zone_in": ("observer.ingress.zone", "CASE WHEN kind NOT IN ('other', 'icmp') THEN 'outside' END"),
        "zone_out": ("observer.egress.zone", "CASE WHEN kind NOT IN ('other', 'icmp') THEN 'dmz' END"),
        "duration": ("event.duration", "CASE WHEN kind = 'teardown' THEN (h * 3600 + m * 60 + s) * 1000000000 END"),
        "bytes": ("network.bytes", "CASE WHEN kind = 'teardown' THEN size END"),
        "reason": ("event.reason", # With no reason in the line, a user in brackets reads as one.
                   "CASE WHEN kind = 'teardown' THEN coalesce(reason, '(' || who || ')') END"),
        "user_name": ("user.name", "CASE WHEN kind = 'built' OR (kind = 'teardown' AND reason IS NOT NULL) THEN who END"),
        "rule": ("rule.name", "CASE WHEN kind = 'deny' THEN concat('ACL_', l_suppkey) END"),
        "connection": ("try_element_at(unmapped, 'connection_id')", "CASE WHEN kind IN ('built', 'teardown') THEN concat('\"', l_orderkey, '\"') END"),
        "icmp_id": ("try_element_at(unmapped, 'icmp_id')", "CASE WHEN kind = 'icmp' THEN '\"0\"' END"),
    },
    "syslog": {
        "seq": ("pipeline.ingest.seq", "seq"),
        "ts": ("`@timestamp`", "concat(strftime(o_orderdate, '%Y-%m-%d'), 'T10:20:30.123+00:00')"),
        "host_name": ("host.name", "concat('HOST-', o_custkey % 9)"),
        "process": ("process.name", "app"),
        "pid": ("process.pid", "pid"),
        "severity": ("event.severity", "CAST([10, 9, 8, 7, 5, 4, 2, 1][pri % 8 + 1] AS BIGINT)"),
        "facility": ("log.syslog.facility.code", "CAST(floor(pri / 8) AS BIGINT)"),
        "facility_name": ("log.syslog.facility.name", "['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','security','console','solaris-cron','local0','local1','local2','local3','local4','local5','local6','local7'][CAST(floor(pri / 8) AS BIGINT) + 1]"),
        "category": (_join("event.category"), "CASE kind WHEN 'firewall' THEN 'network' WHEN 'sudo' THEN 'process' WHEN 'session' THEN 'session' WHEN 'other' THEN 'host' ELSE 'authentication' END"),
        "event_type": (_join("event.type"), "CASE kind WHEN 'firewall' THEN CASE WHEN blocked THEN 'connection,denied' ELSE 'connection,allowed' END WHEN 'session' THEN CASE WHEN opened THEN 'start' ELSE 'end' END WHEN 'other' THEN 'info' ELSE 'start' END"),
        "action": ("event.action", "CASE kind WHEN 'firewall' THEN CASE WHEN blocked THEN 'block' ELSE 'allow' END WHEN 'sudo' THEN 'sudo' WHEN 'session' THEN CASE WHEN opened THEN 'session_opened' ELSE 'session_closed' END WHEN 'refused' THEN 'auth_failure' WHEN 'other' THEN NULL ELSE 'ssh_login' END"),
        "outcome": ("event.outcome", "CASE WHEN kind IN ('refused', 'no_login') THEN 'failure' WHEN kind = 'other' THEN 'unknown' ELSE 'success' END"),
        "user_name": ("user.name", "CASE WHEN kind IN ('sudo', 'session', 'login', 'no_login') THEN who END"),
        "effective": ("user.effective.name", "CASE WHEN kind = 'sudo' OR (kind = 'session' AND opened) THEN 'root' END"),
        "sip": ("source.ip", "CASE WHEN kind IN ('firewall', 'login', 'no_login') THEN sip END"),
        "sport": ("source.port", "CASE WHEN kind IN ('firewall', 'login', 'no_login') THEN sport END"),
        "dip": ("destination.ip", "CASE WHEN kind = 'firewall' THEN dip END"),
        "dport": ("destination.port", "CASE WHEN kind = 'firewall' THEN dport END"),
        "iface": ("observer.ingress.interface.name", "CASE WHEN kind = 'firewall' THEN concat('ens', o_custkey % 4) END"),
        "iface_out": ("observer.egress.interface.name", "CAST(NULL AS VARCHAR)"),
        "flags": ("try_element_at(unmapped, 'tcp_flags')", "CASE WHEN kind = 'firewall' THEN '\"SYN\"' END"),
        "ip_id": ("try_element_at(unmapped, 'ip_id')", "CASE WHEN kind = 'firewall' THEN concat('\"', o_orderkey, '\"') END"),
        "uid": ("try_element_at(unmapped, 'uid')", "CASE WHEN kind = 'session' AND opened THEN concat('\"', o_custkey, '\"') END"),
        "service": ("try_element_at(unmapped, 'pam_service')", "CASE kind WHEN 'session' THEN '\"cron\"' WHEN 'refused' THEN '\"su\"' END"),
        "method": ("try_element_at(unmapped, 'auth_method')", "CASE WHEN kind IN ('login', 'no_login') THEN '\"password\"' END"),
        "command": ("CASE WHEN event.action = 'sudo' THEN message END", "CASE WHEN kind = 'sudo' THEN concat('/bin/run ', o_orderkey) END"),
    },
    "proxy_access": {
        "seq": ("pipeline.ingest.seq", "seq"),
        "ts": ("`@timestamp`", "concat(strftime(o_orderdate, '%Y-%m-%d'), 'T01:02:03.000+00:00')"),
        "ip": ("source.ip", "ip"),
        "user_domain": ("user.domain", "CASE WHEN who IS NOT NULL THEN domain END"),
        "user_name": ("user.name", "who"),
        "domain": ("url.domain", "host"),
        "dest": ("destination.domain", "host"),
        "port": ("url.port", "CASE WHEN tunnel THEN CAST(443 AS BIGINT) END"),
        "scheme": ("url.scheme", "CASE WHEN tunnel THEN 'https' ELSE 'http' END"),
        "protocol": ("network.protocol", "CASE WHEN tunnel THEN 'ssl' ELSE 'http' END"),
        "path": ("url.path", "CASE WHEN NOT tunnel THEN CASE WHEN path = '' THEN '/' ELSE path END END"),
        "query": ("url.query", "CASE WHEN NOT tunnel THEN query END"),
        "status": ("http.response.status_code", "CAST(code AS BIGINT)"),
        "request_bytes": ("http.request.bytes", "CASE WHEN listed THEN cs END"),
        "response_bytes": ("http.response.bytes", "CASE WHEN listed THEN sc END"),
        "network_bytes": ("network.bytes", "CASE WHEN listed AND tunnel THEN cs + sc END"),
        "duration": ("event.duration", "CASE WHEN listed AND tunnel THEN CAST(floor(CAST(ms AS DOUBLE) / 1000 * 1e9) AS BIGINT) END"),
        "action": ("event.action", "CASE WHEN listed THEN concat('proxy_', action) ELSE 'proxy_request' END"),
        "event_type": (_join("event.type"), "CASE WHEN code = 403 OR coalesce(lower(action) IN ('deny', 'block'), false) THEN 'access,denied' ELSE 'access,allowed' END"),
        "outcome": ("event.outcome", "CASE WHEN code >= 400 OR coalesce(lower(action) IN ('deny', 'block'), false) THEN 'failure' ELSE 'success' END"),
        "ssl_bump": ("try_element_at(unmapped, 'ssl_bump')", "CASE WHEN listed THEN concat('\"', lower(o_orderstatus), '\"') END"),
        "related_hosts": (_join("related.hosts"), "host"),
    },
    "zeek_conn": {
        "seq": ("pipeline.ingest.seq", "seq"),
        "ts": ("`@timestamp`", "concat(strftime(make_timestamp((1700000000 + l_orderkey) * 1000000), '%Y-%m-%dT%H:%M:%S'), '.250+00:00')"),
        "sip": ("source.ip", "oh"), "sport": ("source.port", "op"),
        "dip": ("destination.ip", "rh"), "dport": ("destination.port", "rp"),
        "transport": ("network.transport", "proto"),
        "duration": ("event.duration", "CAST(floor(CAST(ms AS DOUBLE) / 1000 * 1e9) AS BIGINT)"),
        "sbytes": ("source.bytes", "ob"), "dbytes": ("destination.bytes", "rb"),
        "bytes": ("network.bytes", "CASE WHEN ob IS NOT NULL OR rb IS NOT NULL THEN coalesce(ob, 0) + coalesce(rb, 0) END"),
        "packets": ("network.packets", "CAST(l_linenumber AS BIGINT)"),
        "net_type": ("network.type", "CASE WHEN six THEN 'ipv6' ELSE 'ipv4' END"),
        "direction": ("network.direction", "CASE WHEN lr IS NOT NULL THEN CASE WHEN lo THEN CASE WHEN lr THEN 'internal' ELSE 'outbound' END ELSE CASE WHEN lr THEN 'inbound' ELSE 'external' END END END"),
        "action": ("event.action", "CASE WHEN state IS NULL THEN 'connection' ELSE concat('connection_', lower(state)) END"),
        "event_type": (_join("event.type"), "CASE WHEN state IN ('SF', 'S2', 'S3', 'RSTO', 'RSTR') THEN 'connection,end' WHEN state IN ('S0', 'S1', 'SH', 'SHR') THEN 'connection,start' WHEN state IN ('REJ', 'RSTOS0', 'RSTRH') THEN 'connection,denied' WHEN state = 'OTH' THEN 'connection,info' ELSE 'connection' END"),
        "outcome": ("event.outcome", "CASE WHEN state IN ('SF', 'S1', 'S2', 'S3', 'RSTO', 'RSTR') THEN 'success' WHEN state IN ('REJ', 'RSTOS0', 'RSTRH') THEN 'failure' ELSE 'unknown' END"),
        "message": ("message", "trim(concat(oh, ':', op, ' -> ', rh, ':', rp, ' ', upper(proto), ' ', coalesce(state, '')))"),
        "quantity": ("unmapped['tags.q']", "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"),
        "line_no": ("unmapped['tags.line.no']", "CAST(l_linenumber AS VARCHAR)"),
        "history": ("unmapped['history']", "'\"ShAD\"'"),
        "user_name": ("user.name", "who"), "related_user": (_join("related.user"), "who"),
        "zone": ("observer.ingress.zone", "zone"), "nat_port": ("source.nat.port", "CAST(NULL AS BIGINT)"),
        "bad_port": ("try_element_at(unmapped, 'source.nat.port')", "CASE WHEN zone IS NOT NULL THEN '\"high\"' END"),
        "no_user": ("try_element_at(unmapped, 'user.name')", "CAST(NULL AS VARCHAR)"),
    },
    "zeek_dns": {
        "seq": ("pipeline.ingest.seq", "seq"),
        "ts": ("`@timestamp`", "concat(strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%S'), '.000+00:00')"),
        "sip": ("source.ip", "concat('198.18.10.', user_id % 250)"),
        "dns_id": ("dns.id", "CAST(event_id AS VARCHAR)"),
        "question": ("dns.question.name", "name"),
        "rcode": ("dns.response_code", "rcode"),
        "duration": ("event.duration", "CAST(floor(CAST(us AS DOUBLE) / 1000000 * 1e9) AS BIGINT)"),
        "flags": (_join("dns.header_flags"), "concat(CASE WHEN aa THEN 'AA,' ELSE '' END, CASE WHEN rd THEN 'RD,' ELSE '' END, 'RA')"),
        "outcome": ("event.outcome", "CASE WHEN rcode = 'NOERROR' THEN 'success' WHEN rcode IS NULL THEN 'unknown' ELSE 'failure' END"),
        "action": ("event.action", "CASE WHEN answers > 0 OR rcode IS NOT NULL THEN 'dns_response' ELSE 'dns_query' END"),
        "event_type": (_join("event.type"), "'protocol,info'"),
        "resolved": (_join("dns.resolved_ip"), "CASE answers WHEN 0 THEN NULL WHEN 3 THEN concat(ip1, ',2001:db8::', CASE WHEN user_id > 0 THEN CAST(user_id AS VARCHAR) ELSE '' END) ELSE ip1 END"),
        "answers": (_join("transform(dns.answers, a -> concat(a.data, '/', coalesce(cast(a.ttl AS STRING), '-')))"),
                    "CASE answers WHEN 0 THEN NULL WHEN 1 THEN concat(ip1, '/600') WHEN 2 THEN concat(ip1, '/60,alias.', name, '/70') ELSE concat(ip1, '/60,2001:DB8:0:0::', user_id, '/-') END"),
        "message": ("message", "trim(concat(name, ' A ', coalesce(rcode, '')))"),
        "uid": ("unmapped['uid']", "concat('\"C', event_id, '\"')"),
        "related_hosts": (_join("related.hosts"), "name"),
        "tags": (_join("tags"), "CASE WHEN tagged THEN concat('lab,u', user_id) END"),
        "created": ("event.created", "CASE WHEN tagged THEN concat(strftime(make_timestamp((1600000000 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%S'), '.000+00:00') END"),
        "host_ip": (_join("host.ip"), "CASE WHEN tagged THEN '2001:db8::7' END"),
        "left_keys": (_join("array_sort(map_keys(unmapped))"), "CASE WHEN answers > 0 THEN 'TTLs,uid' ELSE 'uid' END"),
    },
    "zeek_http": {
        "seq": ("pipeline.ingest.seq", "seq"),
        "ts": ("`@timestamp`", "concat(strftime(make_timestamp((1700000000 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%S'), '.500+00:00')"),
        "method": ("http.request.method", "CASE WHEN form = 'tunnel' THEN 'CONNECT' ELSE 'GET' END"),
        "domain": ("url.domain", "host"),
        "port": ("url.port", "CASE WHEN form = 'tunnel' THEN CAST(443 AS BIGINT) END"),
        "full_url": ("url.full", "CASE form WHEN 'tunnel' THEN concat(host, ':443') WHEN 'path' THEN concat('http://', host, path, coalesce('?' || query, '')) ELSE url END"),
        "scheme": ("url.scheme", "CASE form WHEN 'path' THEN 'http' WHEN 'absolute' THEN scheme END"),
        "path": ("url.path", "CASE WHEN form <> 'tunnel' THEN path END"),
        "query": ("url.query", "CASE WHEN form <> 'tunnel' THEN query END"),
        "status": ("http.response.status_code", "CAST(code AS BIGINT)"),
        "body": ("http.response.body.bytes", "size"),
        "mime": ("http.response.mime_type", "CASE WHEN code = 200 THEN 'text/html' END"),
        "outcome": ("event.outcome", "CASE WHEN code IS NULL THEN 'unknown' WHEN code < 400 THEN 'success' ELSE 'failure' END"),
        "depth": ("unmapped['trans_depth']", "'1'"),
        "mimes": ("try_element_at(unmapped, 'resp_mime_types')", "CASE WHEN code = 200 THEN '[\"text/html\",\"x/y\"]' END"),
        "related_hosts": (_join("related.hosts"), "host"),
        "error_code": ("error.code", "fault"), "error_message": ("error.message", "CASE WHEN fault IS NOT NULL THEN 'slow' END"),
        "pid": ("process.pid", "CASE WHEN fault IS NOT NULL THEN CAST(page_id AS BIGINT) END"),
    },
}

# Failed lines: error text by source, and the condition on the facts.
_HEADER_ERRORS = {
    "web_access": "ValueError:apache combined mismatch", "snort_alert": "ValueError:snort fast-format mismatch",
    "cisco_asa": "ValueError:ASA header mismatch", "syslog": "ValueError:RFC5424 header mismatch",
}
FAILURE: dict[str, tuple[str, str]] = {
    **{n: ("broken", f"'{m}'") for n, m in _HEADER_ERRORS.items()},
    "proxy_access": ("broken OR bad_count", "CASE WHEN broken THEN 'ValueError:proxy access mismatch' ELSE "
                     "'ValueError:invalid literal for int() with base 10: ''many''' END"),
    "zeek_conn": ("broken", "CASE WHEN l_linenumber % 3 = 0 THEN 'AttributeError:''list'' object has no attribute ''items''' "
                  "ELSE 'JSONDecodeError:invalid JSON' END"),
    "zeek_dns": ("broken", "'JSONDecodeError:invalid JSON'"),
    "zeek_http": ("broken", "'JSONDecodeError:invalid JSON'"),
}


def extraction_query(log_type: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        df = normalized(spark, sf_dir, render.RENDERINGS[log_type])
        return df.selectExpr(*[f"{e} AS {n}" for n, (e, _) in EXPECTED[log_type].items()])
    return run


def extraction_oracle(log_type: str) -> str:
    r = render.RENDERINGS[log_type]
    columns = ", ".join(f"{e} AS {n}" for n, (_, e) in EXPECTED[log_type].items())
    return f"WITH f AS ({r.facts_sql()}) SELECT {columns} FROM f WHERE NOT ({FAILURE[log_type][0]})"


def failures_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse failures of every source by reason."""
    configure(spark)
    parts = [failures(spark, sf_dir, r).selectExpr(f"'{n}' AS log_type", "reason") for n, r in render.RENDERINGS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("log_type", "reason").agg(F.count("*").alias("n"))


def failures_oracle() -> str:
    parts = [f"SELECT '{n}' AS log_type, concat('parse_error:', {FAILURE[n][1]}) AS reason FROM ({r.facts_sql()}) "
             f"WHERE {FAILURE[n][0]}" for n, r in render.RENDERINGS.items()]
    return f"SELECT log_type, reason, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"
