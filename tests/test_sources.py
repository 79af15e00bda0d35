"""Hand-derived expectations for typical lines of every source."""

import json

import pytest

from logweir.operators.envelope import envelope
from logweir.operators.normalize import normalize
from logweir.operators.route import parse_failures
from logweir.sources import SOURCES
from logweir.sources.sinks import document_json

ASA = "<165>Feb 9 07:45:02 edge-turin %ASA-5-302014: Teardown UDP connection 90 for garden:198.51.100.44/5060 to lab:192.0.2.61/5061 duration 2:00:05 bytes 4096 Idle limit"
LINES = {
    "cisco_asa": [
        ASA,
        '<163>Feb  3 07:46:10 edge-turin %ASA-3-106023: Deny icmp src garden:203.0.113.9 dst lab:192.0.2.61 (type 3, code 1) by access-group "STEP" [0x0, 0x0]',
        "<166>Feb 9 07:46:11 edge-turin %ASA-6-302020: Built inbound ICMP connection for faddr 198.51.100.5/0 gaddr 203.0.113.77/0 laddr 192.0.2.61/0",
        "<166>Feb 9 07:46:12 edge-turin %ASA-6-111008: User 'a' executed a command",
        "no header",
    ],
    "snort_alert": [
        "02/09-07:47:33.501200 [**] [3:51900:4] ODD length field [**] [Classification: Protocol oddity] [Priority: 2] {UDP} 198.51.100.5 -> 192.0.2.61",
        "02/09-07:48:00.000999 [**] [7:20:14] Sweep [**] [Priority: 1] {TCP} 203.0.113.2:40404 -> 192.0.2.61:22",
    ],
    "syslog": [
        "<12>1 2024-02-09T07:49:00.125Z loom-3 kernel - - - [88.5] [UFW ALLOW] IN=wlan7 OUT= SRC=198.51.100.44 DST=192.0.2.61 PROTO=UDP SPT=68 DPT=67 ACK",
        "<85>1 2024-02-09T07:49:35Z loom-3 sudo 611 - - ines : TTY=pts/9 ; PWD=/var ; USER=root ; COMMAND=/usr/sbin/weave --all",
        '<86>1 2024-02-09T09:50:35+02:00 loom-3 app 4 ID7 [ex@1 a="b"][more] hello',
    ],
    "web_access": [
        '2001:DB8::0001 - - [09/Feb/2024:07:51:14 +0000] "GET /leaf.svg HTTP/1.1" 304 - "-" "-"',
        '192.0.2.4 - ines [09/Feb/2024:07:51:15 +0000] "GET HTTPS://u@EX.org:8443/a?b#c HTTP/1.1" 503 7 "r" "ua"',
        'host - - [09/Feb/2024:07:51:16 +0000] "GET / HTTP/1.1" 200 7 "-" "ua"',
    ],
    "proxy_access": [
        '192.0.2.18 - MILL\\ravi [09/Feb/2024:07:52:51 +0000] "CONNECT seeds.example:8443 HTTP/1.1" 200 64 "-" "spade" "cs_bytes=71 proxy_action=tunnel-end ssl_bump=stare tunnel_cs_bytes=1000 tunnel_sc_bytes=2500 tunnel_duration_ms=1250"',
        '192.0.2.18 - - [09/Feb/2024:07:52:52 +0000] "GET http://a.b HTTP/1.1" 200 253 "-" "M" "sc_bytes=x"',
    ],
    "zeek_conn": [
        '{"proto":"tcp","id.orig_h":"192.0.2.18","id.orig_p":49001,"id.resp_h":"198.51.100.44","id.resp_p":443,"ts":1707465173.5,"duration":1.25,"resp_bytes":99,"conn_state":"RSTO","local_orig":false,"local_resp":true,"w":{"v":{"u":[7,8.50]}},"user":{"name":"ravi"},"tags":"one","source.port":"x"}',
        '{"id":{"orig_h":"bad"},"ts":null}',
        '{"a":1} trailing',
        "[1]",
    ],
    "zeek_dns": [
        '{"ts":1707465180.25,"query":"leaf.example","qtype_name":"AAAA","rcode_name":"NOERROR","AA":true,"RD":false,"answers":["192.0.2.80","alias.example","2001:DB8:0:0::1"],"TTLs":[30.0,45.5]}',
        '{"query":"leaf.example"}',
    ],
    "zeek_http": [
        '{"method":"CONNECT","host":"h.x","uri":"h.x:443","status_code":403,"resp_mime_types":["text/html"]}',
        '{"method":"GET","host":"h.x","uri":"/p?q=1","status_code":200,"error":{"code":17},"tags":["a","b"]}',
        '{"method":"GET","host":"proxy","uri":"http://O.x:81/p","username":"u"}',
        '{"method":"GET","uri":"http://O.x:99999/p"}',
    ],
}


@pytest.fixture(scope="module")
def docs(spark):
    """Documents and failures of every source, keyed by (source, line number)."""
    good, bad = {}, {}
    for log_type, lines in LINES.items():
        df = envelope(spark.createDataFrame([("x.log", i + 1, raw) for i, raw in enumerate(lines)],
                                            "source string, seq bigint, raw string"))
        for row in document_json(normalize(df, SOURCES[log_type], 2024)).collect():
            doc = json.loads(row.value)
            good[log_type, doc["pipeline"]["ingest"]["seq"]] = doc
        for row in parse_failures(df, SOURCES[log_type]).collect():
            bad[log_type, row.seq] = row.reason
    return good, bad


def _get(doc, path):
    for part in path.split("."):
        if not isinstance(doc, dict) or part not in doc:
            return None
        doc = doc[part]
    return doc


EXPECTED = {
    ("cisco_asa", 1): {"@timestamp": "2024-02-09T07:45:02.000+00:00", "event.code": "302014", "event.action": "teardown",
                       "event.type": ["connection", "end"], "event.outcome": "success", "event.severity": 4,
                       "event.duration": 7_205_000_000_000, "network.bytes": 4096, "event.reason": "Idle limit",
                       "network.transport": "udp", "log.syslog.facility.name": "local4", "source.port": 5060,
                       "cisco.asa": {"connection_id": "90"}, "related.ip": ["192.0.2.61", "198.51.100.44"],
                       "related.hosts": ["edge-turin"], "observer.type": "firewall", "user": None},
    ("cisco_asa", 2): {"@timestamp": "2024-02-03T07:46:10.000+00:00", "event.type": ["connection", "denied"],
                       "event.outcome": "failure", "rule.name": "STEP", "source.port": None, "event.severity": 7,
                       "cisco.asa": {"icmp_type": "3", "icmp_code": "1"}},
    ("cisco_asa", 3): {"network.transport": "icmp", "event.type": ["connection", "start"], "destination.nat.ip": "203.0.113.77",
                       "network.direction": "inbound", "cisco.asa": {"icmp_id": "0"}},
    ("cisco_asa", 4): {"event.type": ["info"], "event.outcome": "unknown", "event.action": None, "cisco": None},
    ("snort_alert", 1): {"event.severity": 6, "rule.ruleset": "snort-so", "event.kind": "alert", "source.port": None,
                         "snort.alert": {"gid": "3", "priority": 2}, "@timestamp": "2024-02-09T07:47:33.501+00:00"},
    ("snort_alert", 2): {"event.severity": 9, "rule.ruleset": "gid-7", "rule.category": None, "destination.port": 22},
    ("syslog", 1): {"event.severity": 5, "event.category": ["network"], "event.type": ["connection", "allowed"],
                    "event.action": "allow", "observer.ingress.interface.name": "wlan7", "observer.egress": None,
                    "system.syslog.tcp_flags": "ACK", "system.syslog.kernel_uptime": 88.5, "log.syslog.facility.code": 1},
    ("syslog", 2): {"message": "/usr/sbin/weave --all", "user.effective.name": "root", "user.name": "ines", "process.pid": 611,
                    "related.user": ["ines", "root"], "system.syslog": {"tty": "pts/9", "pwd": "/var"}},
    ("syslog", 3): {"@timestamp": "2024-02-09T07:50:35.000+00:00", "message": "hello", "event.category": ["host"],
                    "log.syslog.msgid": "ID7", "system.syslog": {"structured_data": '[ex@1 a="b"][more]'}},
    ("web_access", 1): {"source.ip": "2001:db8::1", "http.response.body.bytes": 0, "event.outcome": "success",
                        "user_agent": None, "url.path": "/leaf.svg"},
    ("web_access", 2): {"url.domain": "ex.org", "url.scheme": "https", "url.query": "b", "url.path": "/a",
                        "event.type": ["access", "error"], "user.name": "ines", "related.user": ["ines"]},
    ("web_access", 3): {"source": None, "apache.access": {"source.ip": "host"}, "related": None},
    ("proxy_access", 1): {"user.domain": "MILL", "user.name": "ravi", "url.domain": "seeds.example", "url.port": 8443,
                          "url.path": None, "network.bytes": 3500, "event.duration": 1_250_000_000,
                          "event.action": "proxy_tunnel-end", "event.type": ["access", "allowed"],
                          "squid.access": {"ssl_bump": "stare"}, "network.protocol": "ssl"},
    ("zeek_conn", 1): {"event.duration": 1_250_000_000, "network.direction": "inbound", "network.bytes": 99,
                       "event.type": ["connection", "end"], "message": "192.0.2.18:49001 -> 198.51.100.44:443 tcp RSTO",
                       "user.name": "ravi", "related.user": ["ravi"], "tags": ["one"], "source.port": 49001,
                       "zeek.conn": {"conn_state": "RSTO", "local_orig": False, "local_resp": True, "w.v.u": [7, 8.5], "source.port": "x"}},
    ("zeek_conn", 2): {"source": None, "zeek.conn": {"id.orig_h": "bad"}, "event.action": "connection",
                       "event.type": ["connection"], "event.outcome": "unknown"},
    ("zeek_dns", 1): {"dns.answers": [{"data": "192.0.2.80", "ttl": 30}, {"data": "alias.example", "ttl": 45}, {"data": "2001:DB8:0:0::1"}],
                      "dns.resolved_ip": ["192.0.2.80", "2001:db8::1"], "dns.header_flags": ["AA"], "event.outcome": "success",
                      "zeek.dns.TTLs": [30, 45.5], "related.hosts": ["leaf.example"]},
    ("zeek_dns", 2): {"event.action": "dns_query", "event.outcome": "unknown", "message": "leaf.example", "zeek": None},
    ("zeek_http", 1): {"url.domain": "h.x", "url.port": 443, "url.full": "h.x:443", "event.outcome": "failure",
                       "http.response.mime_type": "text/html", "url.scheme": None},
    ("zeek_http", 2): {"url.full": "http://h.x/p?q=1", "url.path": "/p", "url.query": "q=1", "url.scheme": "http",
                       "url.domain": "h.x", "error.code": "17", "tags": ["a", "b"], "zeek": None},
    ("zeek_http", 3): {"url.domain": "o.x", "url.port": 81, "url.scheme": "http", "event.outcome": "unknown",
                       "message": "GET http://O.x:81/p"},
}


@pytest.mark.parametrize("key", sorted(EXPECTED))
def test_document(docs, key):
    doc = docs[0][key]
    assert {p: _get(doc, p) for p in EXPECTED[key]} == EXPECTED[key]


def test_failures(docs):
    assert docs[1] == {
        ("cisco_asa", 5): "parse_error:ValueError:ASA header mismatch",
        ("proxy_access", 2): "parse_error:ValueError:invalid literal for int() with base 10: 'x'",
        ("zeek_conn", 3): "parse_error:JSONDecodeError:invalid JSON",
        ("zeek_conn", 4): "parse_error:AttributeError:'list' object has no attribute 'items'",
        ("zeek_http", 4): "parse_error:ValueError:invalid port",
    }


def test_no_python_and_one_branch_per_source(spark):
    """Expression sources stay in the JVM and join nothing."""
    df = envelope(spark.createDataFrame([("x.log", 1, ASA)], "source string, seq bigint, raw string"))
    for spec in SOURCES.values():
        plan = normalize(df, spec, 2024)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan
