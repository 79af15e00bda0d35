"""Log lines rendered from the driver's tables, for queries that check extraction.

Each rendering has *facts* (SQL that Spark and DuckDB both read, over one
table) and a Spark template that writes a raw line from them. A query extracts
the line again; its oracle selects the facts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .query import table

YEAR = 2024
RECEIVED = "timestamp'2026-01-01 00:00:00'"
RECEIVED_TEXT = "2026-01-01T00:00:00.000+00:00"


@dataclass(frozen=True)
class Rendering:
    """Facts over ``table`` and the raw line made from them."""

    log_type: str
    table: str
    facts: dict[str, str]
    raw: str
    source: str = "'rendered.log'"

    def lines(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """``source, seq, raw`` and the facts' ``seq`` for every row of the table."""
        df = table(spark, sf_dir, self.table)
        facts = [f"{e} AS {n}" for n, e in self.facts.items()]
        return df.selectExpr(*facts, "*").selectExpr(f"{self.source} AS source", "seq", f"{self.raw} AS raw")

    def facts_sql(self) -> str:
        """The facts as DuckDB SQL."""
        return f"SELECT {', '.join(f'{e} AS {n}' for n, e in self.facts.items())}, * FROM {self.table}"


def _two(x):
    return f"lpad(CAST({x} AS STRING), 2, '0')"


WEB = Rendering(
    log_type="web_access", table="events",
    facts={
        "seq": "event_id",
        "broken": "event_id % 17 = 0",
        "ip": "concat('10.', user_id % 200, '.', event_id % 250, '.', 1 + user_id % 9)",
        "who": "CASE WHEN user_id % 4 = 0 THEN concat('u', user_id) END",
        "verb": "CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END",
        "absolute": "event_id % 5 = 0",
        "path": "concat('/', event_type, '/', user_id)",
        "query": "CASE WHEN event_id % 3 = 0 THEN concat('k=', event_id, '&z=1') END",
        "code": "CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 403 ELSE 404 END "
                "WHEN event_type = 'click' THEN 302 ELSE 200 END",
        "size": "CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END",
        "ref": "CASE WHEN event_id % 4 = 1 THEN concat('https://ref.example/', user_id) END",
    },
    raw="concat(CASE WHEN broken THEN '#' ELSE '' END, ip, ' - ', coalesce(who, '-'), ' [', "
        "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"', verb, ' ', "
        "CASE WHEN absolute THEN 'http://Shop.Example.com:8080' ELSE '' END, path, "
        "CASE WHEN query IS NOT NULL THEN concat('?', query) ELSE '' END, ' HTTP/1.', event_id % 2, '\" ', "
        "CASE WHEN broken THEN 'n/a' ELSE cast(code AS STRING) END, ' ', "
        "CASE WHEN event_id % 11 = 0 THEN '-' ELSE cast(size AS STRING) END, ' \"', coalesce(ref, '-'), "
        "'\" \"Mozilla/5.0 (X11; Linux x86_64)\"')",
)

SNORT = Rendering(
    log_type="snort_alert", table="events",
    facts={
        "seq": "event_id",
        "broken": "event_id % 17 = 0",
        "gid": "CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 119 WHEN 3 THEN 129 ELSE 7 END",
        "sid": "1000 + user_id",
        "rev": "1 + event_id % 9",
        "title": "concat('ET ', upper(event_type), ' seen [twice]')",
        "class": "CASE WHEN event_id % 3 > 0 THEN concat('Attempted ', event_type) END",
        "prio": "event_id % 4 + 1",
        "proto": "CASE WHEN event_id % 6 = 0 THEN 'ICMP' WHEN event_id % 6 < 4 THEN 'TCP' ELSE 'UDP' END",
        "sip": "concat('192.', user_id % 200, '.', event_id % 250, '.9')",
        "sport": "CASE WHEN event_id % 6 > 0 THEN 1024 + event_id % 60000 END",
        "dip": "concat('198.18.30.', user_id % 250)",
        "dport": "CASE WHEN event_id % 6 > 0 THEN 1 + user_id % 1000 END",
    },
    raw="concat(date_format(ts, 'MM/dd-HH:mm:ss.SSSSSS'), ' [**] [', gid, ':', sid, ':', rev, '] ', title, ' [**] ', "
        "CASE WHEN class IS NOT NULL THEN concat('[Classification: ', class, '] ') ELSE '' END, "
        "'[Priority: ', CASE WHEN broken THEN 'high' ELSE cast(prio AS STRING) END, '] {', proto, '} ', "
        "sip, CASE WHEN sport IS NOT NULL THEN concat(':', sport) ELSE '' END, ' -> ', "
        "dip, CASE WHEN dport IS NOT NULL THEN concat(':', dport) ELSE '' END)",
)

ASA = Rendering(
    log_type="cisco_asa", table="lineitem",
    facts={
        "seq": "l_orderkey * 10 + l_linenumber",
        "broken": "(l_orderkey + l_partkey) % 17 = 0",
        "kind": "CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'built' WHEN 1 THEN 'teardown' WHEN 2 THEN 'icmp' "
                "WHEN 3 THEN 'deny' WHEN 4 THEN 'other' ELSE 'teardown' END",
        "sev": "l_linenumber % 8",
        "inbound": "l_partkey % 2 = 0",
        "proto": "CASE WHEN l_suppkey % 2 = 0 THEN 'tcp' ELSE 'udp' END",
        "sip": "concat('100.', l_partkey % 250, '.', l_suppkey % 250, '.', l_linenumber)",
        "sport": "1024 + l_partkey % 60000",
        "nip": "concat('100.66.', l_suppkey % 250, '.5')",
        "dip": "concat('198.18.', l_orderkey % 250, '.10')",
        "dport": "1 + l_suppkey % 1000",
        "h": "CAST(l_quantity AS BIGINT) % 5",
        "m": "l_partkey % 60",
        "s": "l_orderkey % 60",
        "size": "CAST(floor(l_extendedprice) AS BIGINT)",
        "reason": "CASE l_returnflag WHEN 'A' THEN 'TCP FINs' WHEN 'R' THEN 'SYN Timeout' END",
        "who": "CASE WHEN l_partkey % 7 = 0 THEN concat('user', l_suppkey) END",
    },
    raw="concat('<', 160 + sev, CASE WHEN broken THEN '' ELSE '>' END, date_format(l_shipdate, 'MMM d'), ' ', "
        "lpad(h, 2, '0'), ':', lpad(m, 2, '0'), ':', lpad(s, 2, '0'), ' FW-', l_suppkey % 5, ' %ASA-', sev, "
        "'-302013: ', CASE kind "
        "WHEN 'built' THEN concat('Built ', CASE WHEN inbound THEN 'inbound ' ELSE 'outbound ' END, upper(proto), "
        "' connection ', l_orderkey, ' for outside:', sip, '/', sport, ' (', sip, '/', sport, ') to dmz:', dip, '/', "
        "dport, ' (', nip, '/', dport, ')', CASE WHEN who IS NOT NULL THEN concat(' (', who, ')') ELSE '' END) "
        "WHEN 'teardown' THEN concat('Teardown ', upper(proto), ' connection ', l_orderkey, ' for outside:', sip, '/', "
        "sport, ' to dmz:', dip, '/', dport, ' duration ', h, ':', lpad(m, 2, '0'), ':', lpad(s, 2, '0'), ' bytes ', "
        "size, CASE WHEN reason IS NOT NULL THEN concat(' ', reason) ELSE '' END, "
        "CASE WHEN who IS NOT NULL THEN concat(' (', who, ')') ELSE '' END) "
        "WHEN 'icmp' THEN concat(CASE WHEN inbound THEN 'Built inbound' ELSE 'Teardown' END, "
        "' ICMP connection for faddr ', sip, '/0 gaddr ', nip, '/0 laddr ', dip, '/0') "
        "WHEN 'deny' THEN concat('Deny ', proto, ' src outside:', sip, '/', sport, ' dst dmz:', dip, '/', dport, "
        "' by access-group \"ACL_', l_suppkey, '\" [0x0, 0x0]') "
        "ELSE concat('Configured from console by ', coalesce(who, 'admin')) END)",
)

SYSLOG = Rendering(
    log_type="syslog", table="orders",
    facts={
        "seq": "o_orderkey",
        "broken": "o_orderkey % 17 = 0",
        "kind": "CASE o_orderkey % 7 WHEN 0 THEN 'firewall' WHEN 1 THEN 'sudo' WHEN 2 THEN 'session' "
                "WHEN 3 THEN 'refused' WHEN 4 THEN 'login' WHEN 5 THEN 'no_login' ELSE 'other' END",
        "pri": "o_custkey % 192",
        "who": "concat('user', o_custkey)",
        "blocked": "o_orderstatus <> 'F'",
        "opened": "o_orderstatus = 'O'",
        "sip": "concat('100.64.', o_custkey % 250, '.', o_orderkey % 250)",
        "dip": "concat('198.18.30.', o_orderkey % 250)",
        "sport": "1024 + o_custkey % 60000",
        "dport": "1 + o_orderkey % 1000",
        "pid": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey + 100 END",
        "app": "CASE o_orderkey % 7 WHEN 0 THEN 'kernel' WHEN 1 THEN 'sudo' WHEN 2 THEN 'cron' WHEN 3 THEN 'su' "
               "WHEN 4 THEN 'sshd' WHEN 5 THEN 'sshd' ELSE 'daemon' END",
    },
    raw="concat('<', pri, CASE WHEN broken THEN '>x ' ELSE '>1 ' END, date_format(o_orderdate, 'yyyy-MM-dd'), "
        "'T10:20:30.123456Z HOST-', o_custkey % 9, ' ', app, ' ', coalesce(cast(pid AS STRING), '-'), ' - - ', CASE kind "
        "WHEN 'firewall' THEN concat('[', o_orderkey, '.5] [UFW ', CASE WHEN blocked THEN 'BLOCK' ELSE 'ALLOW' END, "
        "'] IN=ens', o_custkey % 4, ' OUT= SRC=', sip, ' DST=', dip, ' LEN=48 TTL=41 ID=', o_orderkey, "
        "' PROTO=TCP SPT=', sport, ' DPT=', dport, ' WINDOW=14600 SYN URGP=0') "
        "WHEN 'sudo' THEN concat(who, ' : TTY=pts/', o_custkey % 10, ' ; PWD=/srv ; USER=root ; COMMAND=/bin/run ', o_orderkey) "
        "WHEN 'session' THEN concat('pam_unix(cron:session): session ', CASE WHEN opened THEN 'opened' ELSE 'closed' END, "
        "' for user ', who, CASE WHEN opened THEN concat('(uid=', o_custkey, ') by root(uid=0)') ELSE '' END) "
        "WHEN 'refused' THEN concat('pam_unix(su:auth): authentication failure; user=', who) "
        "WHEN 'login' THEN concat('Accepted password for ', who, ' from ', sip, ' port ', sport, ' ssh2') "
        "WHEN 'no_login' THEN concat('Failed password for ', CASE WHEN blocked THEN 'invalid user ' ELSE '' END, who, "
        "' from ', sip, ' port ', sport, ' ssh2') "
        "ELSE concat('checked order ', o_orderkey) END)",
)

PROXY = Rendering(
    log_type="proxy_access", table="orders",
    facts={
        "seq": "o_orderkey",
        "broken": "o_orderkey % 17 = 0",
        "bad_count": "o_orderkey % 17 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 19 = 0",
        "listed": "o_orderkey % 13 > 0",
        "tunnel": "o_orderkey % 3 = 0",
        "ip": "concat('198.18.', o_custkey % 250, '.', o_orderkey % 250)",
        "domain": "CASE WHEN o_custkey % 4 = 0 THEN 'ATELIER' END",
        "who": "CASE WHEN o_custkey % 4 < 2 THEN concat('user', o_custkey) END",
        "host": "concat('site', o_custkey, '.example.com')",
        "path": "CASE WHEN o_orderkey % 5 > 0 THEN concat('/o/', o_orderkey) ELSE '' END",
        "query": "CASE WHEN o_orderkey % 5 = 2 THEN concat('id=', o_custkey) END",
        "code": "CASE o_orderstatus WHEN 'P' THEN 200 WHEN 'F' THEN 403 ELSE 502 END",
        "action": "CASE WHEN o_orderkey % 13 > 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'deny' WHEN 1 THEN 'tunnel' "
                  "WHEN 2 THEN 'forward' ELSE 'BLOCK' END END",
        "cs": "o_custkey + 100",
        "sc": "CAST(floor(o_totalprice) AS BIGINT)",
        "ms": "o_orderkey % 10000",
    },
    raw="concat(ip, ' - ', coalesce(concat(CASE WHEN domain IS NOT NULL THEN 'ATELIER\\\\' ELSE '' END, who), '-'), ' [', "
        "date_format(o_orderdate, 'dd/MMM/yyyy'), ':01:02:03 +0000] \"', "
        "CASE WHEN tunnel THEN concat('CONNECT ', host, ':443') ELSE concat('GET http://', host, path, "
        "CASE WHEN query IS NOT NULL THEN concat('?', query) ELSE '' END) END, ' HTTP/1.1\" ', code, ' ', sc, "
        "' \"-\" \"agent/', o_custkey, CASE WHEN broken THEN '' ELSE '\"' END, CASE WHEN listed THEN concat(' \"cs_bytes=', "
        "CASE WHEN bad_count THEN 'many' ELSE cast(cs AS STRING) END, ' sc_bytes=', sc, ' proxy_action=', action, "
        "' ssl_bump=', lower(o_orderstatus), CASE WHEN tunnel THEN concat(' tunnel_cs_bytes=', cs, ' tunnel_sc_bytes=', sc, "
        "' tunnel_duration_ms=', ms) ELSE '' END, '\"') ELSE '' END)",
)

_CONN_STATES = "SF S0 S1 S2 S3 REJ RSTO RSTR RSTOS0 RSTRH SH SHR OTH ODD".split()

CONN = Rendering(
    log_type="zeek_conn", table="lineitem",
    facts={
        "seq": "l_orderkey * 10 + l_linenumber",
        "broken": "(l_orderkey + l_partkey) % 17 = 0",
        "nested": "l_suppkey % 3 = 0",
        "state": "CASE l_partkey % 15 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_CONN_STATES)) + " END",
        "six": "l_partkey % 10 = 0",
        "oh": "CASE WHEN l_partkey % 10 = 0 THEN '2001:db8::1' ELSE concat('198.18.', l_partkey % 250, '.', l_suppkey % 250) END",
        "op": "1024 + l_partkey % 60000",
        "rh": "concat('198.19.', l_orderkey % 250, '.7')",
        "rp": "1 + l_suppkey % 1000",
        "proto": "CASE WHEN l_linestatus = 'O' THEN 'tcp' ELSE 'udp' END",
        "ms": "l_orderkey % 100000",
        "ob": "CASE WHEN l_linenumber % 4 > 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END",
        "rb": "CASE WHEN l_linenumber % 4 > 1 THEN l_partkey END",
        "lo": "l_orderkey % 2 = 0",
        "lr": "CASE WHEN l_orderkey % 5 > 0 THEN l_partkey % 2 = 0 END",
        # Keys that are schema paths: nested and dotted, of every kind, one that does not coerce.
        "who": "CASE WHEN l_partkey % 11 = 0 THEN concat('op', l_suppkey) END",
        "zone": "CASE WHEN l_partkey % 13 = 0 THEN 'lab' END",
    },
    raw="CASE WHEN broken AND l_linenumber % 3 = 0 THEN concat('[', l_orderkey, ']') ELSE concat('{\"ts\":', 1700000000 + l_orderkey, '.25,', "
        "CASE WHEN nested THEN concat('\"id\":{\"orig_h\":\"', oh, '\",\"orig_p\":', op, ',\"resp_h\":\"', rh, '\",\"resp_p\":', rp, '}') "
        "ELSE concat('\"id.orig_h\":\"', oh, '\",\"id.orig_p\":', op, ',\"id.resp_h\":\"', rh, '\",\"id.resp_p\":', rp) END, "
        "',\"proto\":\"', upper(proto), '\",\"duration\":', cast(ms / 1000D AS DECIMAL(12, 3)), "
        "coalesce(concat(',\"orig_bytes\":', ob), ''), coalesce(concat(',\"resp_bytes\":', rb), ''), "
        "coalesce(concat(',\"conn_state\":\"', state, '\"'), ''), ',\"local_orig\":', lo, ',\"local_resp\":', coalesce(cast(lr AS STRING), 'null'), "
        "',\"orig_pkts\":', l_linenumber, ',\"history\":\"ShAD\",\"tags\":{\"q\":', cast(l_quantity AS BIGINT), "
        "',\"line\":{\"no\":', l_linenumber, '}}', coalesce(concat(',\"user\":{\"name\":\"', who, '\"}'), ''), "
        "coalesce(concat(',\"observer.ingress.zone\":\"', zone, '\",\"source.nat.port\":\"high\"'), ''), CASE WHEN broken THEN '' ELSE '}' END) END",
)

DNS = Rendering(
    log_type="zeek_dns", table="events",
    facts={
        "seq": "event_id",
        "broken": "event_id % 17 = 0",
        "rcode": "CASE WHEN event_type = 'error' THEN 'NXDOMAIN' WHEN event_type <> 'click' THEN 'NOERROR' END",
        "answers": "CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 4 END",
        "name": "concat('host', user_id, '.example.net')",
        "ip1": "concat('100.65.', user_id % 250, '.', event_id % 250)",
        "aa": "event_id % 2 = 0",
        "rd": "event_id % 3 = 0",
        "us": "user_id * 7",
        "tagged": "event_id % 7 = 0",
    },
    # answers: none, an address, an address and a name, an address and an IPv6 address (last without TTL)
    raw="concat('{\"ts\":', 1700000000 + event_id, ',\"uid\":\"C', event_id, '\",\"id.orig_h\":\"198.18.10.', user_id % 250, "
        "'\",\"id.orig_p\":', 1024 + user_id, ',\"id.resp_h\":\"198.18.20.10\",\"id.resp_p\":53,\"proto\":\"udp\",\"trans_id\":', event_id, "
        "',\"rtt\":', cast(us / 1000000D AS DECIMAL(12, 6)), ',\"query\":\"', name, '\",\"qclass_name\":\"C_INTERNET\",\"qtype_name\":\"A\"', "
        "coalesce(concat(',\"rcode_name\":\"', rcode, '\"'), ''), ',\"AA\":', aa, ',\"TC\":false,\"RD\":', rd, ',\"RA\":true', "
        "CASE answers WHEN 0 THEN '' WHEN 1 THEN concat(',\"answers\":[\"', ip1, '\"],\"TTLs\":[600.0]') "
        "WHEN 2 THEN concat(',\"answers\":[\"', ip1, '\",\"alias.', name, '\"],\"TTLs\":[60.0,70.0]') "
        "ELSE concat(',\"answers\":[\"', ip1, '\",\"2001:DB8:0:0::', user_id, '\"],\"TTLs\":[60.0]') END, "
        "CASE WHEN tagged THEN concat(',\"tags\":[\"lab\",\"u', user_id, '\"],\"event\":{\"created\":', 1600000000 + event_id, '},\"host.ip\":[\"2001:DB8:0:0::7\",\"nowhere\"]') ELSE '' END, "
        "CASE WHEN broken THEN '}}' ELSE '}' END)",
)

HTTP = Rendering(
    log_type="zeek_http", table="pages",
    facts={
        "seq": "page_id",
        "broken": "page_id % 17 = 0",
        "form": "CASE page_id % 3 WHEN 0 THEN 'tunnel' WHEN 1 THEN 'path' ELSE 'absolute' END",
        "host": "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))",
        "scheme": "regexp_extract(url, '^(https?)://', 1)",
        "path": "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)",
        "query": "nullif(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '')",
        "code": "CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 END",
        "size": "CAST(length(html) AS BIGINT)",
        "fault": "CASE WHEN page_id % 5 = 0 THEN concat('E', page_id % 40) END",
    },
    raw="concat('{\"ts\":', 1700000000 + page_id, '.5,\"id.orig_h\":\"198.18.20.', page_id % 250, '\",\"id.orig_p\":', 1024 + page_id, "
        "',\"id.resp_h\":\"198.18.20.30\",\"id.resp_p\":8080,\"trans_depth\":1,\"method\":\"', CASE WHEN form = 'tunnel' THEN 'CONNECT' ELSE 'get' END, "
        "'\",\"host\":\"', CASE WHEN form = 'absolute' THEN 'other.example' ELSE host END, '\",\"uri\":\"', "
        "CASE form WHEN 'tunnel' THEN concat(host, ':443') WHEN 'path' THEN concat(path, coalesce(concat('?', query), '')) ELSE url END, "
        "'\",\"version\":\"1.1\",\"response_body_len\":', size, coalesce(concat(',\"status_code\":', code), ''), "
        "CASE WHEN code = 200 THEN ',\"resp_mime_types\":[\"text/html\",\"x/y\"]' ELSE '' END, "
        "coalesce(concat(',\"error\":{\"code\":\"', fault, '\",\"message\":\"slow\"},\"process.pid\":\"', page_id, '\"'), ''), "
        "CASE WHEN broken THEN '' ELSE '}' END)",
)

RENDERINGS = {r.log_type: r for r in (ASA, PROXY, SNORT, SYSLOG, WEB, CONN, DNS, HTTP)}

# Lines of several sources in one file, with a classification made up from the row's own columns.
_MIXED = {
    "seq": "event_id + 1",
    "label": "CASE event_type WHEN 'view' THEN 'web_access' WHEN 'click' THEN 'web_access' WHEN 'error' THEN 'snort_alert' "
             "WHEN 'signup' THEN 'zeek_dns' ELSE 'miscellaneous' END",
    "p1": "CAST((event_id * 37) % 1000 AS DOUBLE) / 1000.0",
    "src": "CASE WHEN event_id % 5 = 0 THEN 'tcp://collector:514' ELSE '/logs/mixed.log' END",
    "bad": "event_id % 17 = 0",
}
FOREIGN = "concat('1,', date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ',TRAFFIC,', event_id, ',10.1.', user_id % 250, '.5,allow-', event_type)"


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as lines of four formats, with label, probability and candidates."""
    df = table(spark, sf_dir, "events")

    def line(r: Rendering) -> DataFrame:
        return df.selectExpr(*[f"{e} AS {n}" for n, e in r.facts.items()], "*").selectExpr(
            "*", f"{r.raw} AS _raw")

    web = line(WEB).filter("event_type IN ('view', 'click')").select("event_id", "event_type", "ts", "user_id", "_raw")
    snort = line(SNORT).filter("event_type = 'error'").select("event_id", "event_type", "ts", "user_id", "_raw")
    dns = line(DNS).filter("event_type = 'signup'").select("event_id", "event_type", "ts", "user_id", "_raw")
    foreign = df.filter("event_type = 'purchase'").selectExpr("event_id", "event_type", "ts", "user_id", f"{FOREIGN} AS _raw")
    every = web.union(snort).union(dns).union(foreign)
    return every.selectExpr(*[f"{e} AS {n}" for n, e in _MIXED.items()], "_raw").selectExpr(
        "src AS source", "seq", "_raw AS raw", "label", "p1 AS confidence",
        "array(named_struct('label', label, 'p', round(p1, 4)), "
        "named_struct('label', 'syslog', 'p', round((1D - p1) / 2D, 4))) AS candidates")


def mixed_sql() -> str:
    """What is known of the mixed lines, as DuckDB SQL: one row per event."""
    return (f"SELECT {', '.join(f'{e} AS {n}' for n, e in _MIXED.items())}, *, "
            "CASE WHEN NOT (p1 >= 0.6) THEN 'low_confidence' WHEN label = 'miscellaneous' THEN 'no_plugin' "
            "WHEN bad THEN 'parse_error' END AS kind, "
            "CASE WHEN p1 >= 0.6 THEN label ELSE 'unknown' END AS log_type FROM events")
