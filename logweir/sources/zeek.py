"""Network-monitor records in JSON: connections, name look-ups and HTTP requests."""

from ..functions.coerce import coerce_epoch, coerce_ip_list, coerce_long
from ..functions.sql import code_table, strip
from ..functions.textual import url_stages
from .json_lines import is_true, json_stages, json_type, rest, schema_paths, value
from .spec import SourceSpec

_MONITOR = dict(version="2.0", module="zeek", provider="zeek", observer_vendor="Zeek",
                observer_product="Zeek", observer_type="ids")

# --- fixed values: where the keys of a record go -----------------------------------
_ENDPOINTS = {
    "ts": "@timestamp",
    "id.orig_h": "source.ip", "id.orig_p": "source.port",
    "id.resp_h": "destination.ip", "id.resp_p": "destination.port",
}
CONN_FIELDS = {
    **_ENDPOINTS, "proto": "network.transport", "service": "network.protocol",
    "ip_proto": "network.iana_number", "duration": "event.duration",
    "orig_bytes": "source.bytes", "resp_bytes": "destination.bytes",
    "orig_pkts": "source.packets", "resp_pkts": "destination.packets",
}
DNS_FIELDS = {
    **_ENDPOINTS, "proto": "network.transport", "trans_id": "dns.id", "query": "dns.question.name",
    "qtype_name": "dns.question.type", "qclass_name": "dns.question.class",
    "rcode_name": "dns.response_code", "opcode_name": "dns.op_code", "rtt": "event.duration",
}
HTTP_FIELDS = {
    **_ENDPOINTS, "method": "http.request.method", "version": "http.version", "host": "url.domain",
    "uri": "url.original", "user_agent": "user_agent.original", "referrer": "http.request.referrer",
    "username": "user.name", "request_body_len": "http.request.body.bytes",
    "response_body_len": "http.response.body.bytes", "status_code": "http.response.status_code",
}

# --- fixed values: connection state to (last event type, outcome) ---------------------
CONN_STATE = {
    "SF": ("end", "success"), "S0": ("start", "unknown"), "S1": ("start", "success"),
    "S2": ("end", "success"), "S3": ("end", "success"), "REJ": ("denied", "failure"),
    "RSTO": ("end", "success"), "RSTR": ("end", "success"), "RSTOS0": ("denied", "failure"),
    "RSTRH": ("denied", "failure"), "SH": ("start", "unknown"), "SHR": ("start", "unknown"),
    "OTH": ("info", "unknown"),
}
# --- fixed values: (originator is local, responder is local) to direction --------------
DIRECTION = {"true,true": "internal", "true,false": "outbound",
             "false,true": "inbound", "false,false": "external"}
DNS_FLAGS = ("AA", "TC", "RD", "RA")


def _mapped(field_map):
    """The mapped keys as text."""
    out = {key: value(key) for key in field_map}
    # A number is epoch seconds whatever its size, while number text has to look like a recent date.
    ts = "try_cast(try_element_at(_f, 'ts') AS DOUBLE)"
    out["ts"] = (f"CASE WHEN {ts} > 1e9D AND {ts} < 1e11D OR {json_type('ts')} = 'STRING' THEN {value('ts')} "
                 f"ELSE {coerce_epoch(ts)} END")
    return out


def _either(a, b):
    """Sum of two counters where one may be missing; null when both are."""
    return (f"CASE WHEN {value(a)} IS NOT NULL OR {value(b)} IS NOT NULL THEN "
            f"try_add(coalesce({coerce_long(value(a))}, 0L), coalesce({coerce_long(value(b))}, 0L)) END")


def _counter_errors(pairs):
    arms = []
    for a, b in pairs:
        arms.append(f"WHEN {json_type(a)} = 'STRING' THEN 'TypeError:can only concatenate str (not \"int\") to str'")
        arms.append(f"WHEN {json_type(b)} = 'STRING' THEN "
                    "'TypeError:unsupported operand type(s) for +: \\'int\\' and \\'str\\''")
    return " ".join(arms)


def _join_words(*words):
    return strip("concat(" + ", ' ', ".join(f"coalesce({w}, '')" for w in words) + ")")


def _with_paths(spec: SourceSpec) -> SourceSpec:
    """The source, with keys of a record that are schema paths typed and placed by the schema."""
    return spec.with_changes(stages=(*spec.stages, {"_paths": schema_paths(spec.fields)}), paths="_paths")


CONN = _with_paths(SourceSpec(
    name="zeek_conn", dataset="zeek.conn", **_MONITOR,
    event_category=("network",), event_type=("connection",), field_map=CONN_FIELDS,
    stages=(
        *json_stages(),
        {"_state": value("conn_state"), "_src": f"coalesce({value('id.orig_h')}, '')",
         "_local": f"CASE WHEN map_contains_key(_f, 'local_orig') AND map_contains_key(_f, 'local_resp') "
                   f"THEN concat({is_true('local_orig')}, ',', {is_true('local_resp')}) END"},
    ),
    fields={
        **_mapped(CONN_FIELDS),
        "event.type": "CASE WHEN _f IS NOT NULL THEN array_compact(array('connection', "
                      + code_table({k: v[0] for k, v in CONN_STATE.items()}, "_state") + ")) END",
        "event.outcome": "coalesce(" + code_table({k: v[1] for k, v in CONN_STATE.items()}, "_state") + ", 'unknown')",
        "event.action": "CASE WHEN _state <> '' THEN concat('connection_', lower(_state)) ELSE 'connection' END",
        "network.direction": code_table(DIRECTION, "_local"),
        "network.bytes": _either("orig_bytes", "resp_bytes"),
        "network.packets": _either("orig_pkts", "resp_pkts"),
        "network.type": "CASE WHEN instr(_src, ':') > 0 THEN 'ipv6' ELSE 'ipv4' END",
        "message": _join_words(
            f"concat(_src, ':', coalesce({value('id.orig_p')}, 'None'), ' -> ', coalesce({value('id.resp_h')}, 'None'), "
            f"':', coalesce({value('id.resp_p')}, 'None'))", value("proto"), "_state"),
    },
    residual=rest(CONN_FIELDS),
    error=f"CASE WHEN _f IS NULL THEN _json_error "
          f"{_counter_errors((('orig_bytes', 'resp_bytes'), ('orig_pkts', 'resp_pkts')))} END",
))

DNS = _with_paths(SourceSpec(
    name="zeek_dns", dataset="zeek.dns", **_MONITOR,
    event_category=("network",), event_type=("protocol",), field_map=DNS_FIELDS,
    stages=(
        *json_stages(),
        {"_answers": "try_cast(try_element_at(_f, 'answers') AS ARRAY<STRING>)",
         "_ttls": "try_cast(try_element_at(_f, 'TTLs') AS ARRAY<DOUBLE>)",
         "_rcode": f"nullif({value('rcode_name')}, '')"},
    ),
    fields={
        **_mapped(DNS_FIELDS),
        "network.protocol": "'dns'",
        "dns.answers": "CASE WHEN size(_answers) > 0 THEN transform(_answers, (a, i) -> "
                       "named_struct('data', a, 'ttl', try_cast(get(_ttls, i) AS BIGINT))) END",
        "dns.resolved_ip": coerce_ip_list("_answers"),
        "dns.header_flags": "nullif(array_compact(array("
                            + ", ".join(f"CASE WHEN {is_true(k)} THEN '{k}' END" for k in DNS_FLAGS)
                            + ")), cast(array() AS ARRAY<STRING>))",
        "event.outcome": "CASE WHEN _rcode = 'NOERROR' THEN 'success' WHEN _rcode IS NOT NULL THEN 'failure' "
                         "ELSE 'unknown' END",
        "event.action": "CASE WHEN size(_answers) > 0 OR _rcode IS NOT NULL THEN 'dns_response' ELSE 'dns_query' END",
        "event.type": "array('protocol', 'info')",
        "message": _join_words(value("query"), value("qtype_name"), "_rcode"),
    },
    residual=rest((*DNS_FIELDS, *DNS_FLAGS), "(k = 'answers' AND _answers IS NOT NULL)"),
    error="_json_error",
))

_SPLIT_URI = "CASE WHEN NOT _tunnel AND (_uri LIKE '/%' OR instr(_uri, '://') > 0) THEN _uri END"

HTTP = _with_paths(SourceSpec(
    name="zeek_http", dataset="zeek.http", **_MONITOR,
    event_category=("network", "web"), event_type=("access",), field_map=HTTP_FIELDS,
    stages=(
        *json_stages(),
        {"_method": value("method"), "_hostname": value("host"), "_uri": f"coalesce({value('uri')}, '')",
         "_sc": value("status_code"),
         "_mime": "try_cast(get(try_cast(try_element_at(_f, 'resp_mime_types') AS ARRAY<VARIANT>), 0) AS STRING)"},
        {"_tunnel": "coalesce(_method = 'CONNECT', false)"},
        {"_split": _SPLIT_URI, "_absolute": "NOT _tunnel AND _uri NOT LIKE '/%' AND instr(_uri, '://') > 0"},
        *url_stages("_l", "_split"),
    ),
    fields={
        **_mapped(HTTP_FIELDS),
        # The Host header is the domain unless the request itself names one.
        "host": "CASE WHEN NOT _tunnel AND NOT (_absolute AND _l_host IS NOT NULL) THEN _hostname END",
        "network.transport": "'tcp'",
        "network.protocol": "'http'",
        "url.domain": "CASE WHEN _tunnel THEN coalesce(nullif(regexp_extract(_uri, '^(.*):', 1), ''), _hostname) "
                      "WHEN _absolute THEN _l_host END",
        "url.port": "CASE WHEN _tunnel THEN try_cast(regexp_extract(_uri, '(?:^|:)([0-9]+)$', 1) AS BIGINT) "
                    "WHEN _absolute THEN nullif(_l_port, 0L) END",
        "url.full": "CASE WHEN _tunnel OR _absolute THEN _uri WHEN _split IS NOT NULL AND _hostname <> '' "
                    "THEN concat('http://', _hostname, _uri) END",
        "url.scheme": "CASE WHEN _absolute THEN _l_scheme WHEN _split IS NOT NULL AND _hostname <> '' THEN 'http' END",
        "url.path": "_l_path",
        "url.query": "_l_query",
        "http.response.mime_type": "_mime",
        "event.outcome": "CASE WHEN _sc IS NULL THEN 'unknown' WHEN try_cast(_sc AS DOUBLE) < 400 THEN 'success' "
                         "ELSE 'failure' END",
        "event.action": "'http_request'",
        "message": _join_words("_method", "_uri", "nullif(_sc, '0')"),
    },
    residual=rest(HTTP_FIELDS),
    error="CASE WHEN _f IS NULL THEN _json_error WHEN _absolute AND _l_bad THEN 'ValueError:invalid port' "
          "WHEN _sc IS NOT NULL AND try_cast(_sc AS DOUBLE) IS NULL THEN "
          "concat('ValueError:invalid literal for int() with base 10: \\'', _sc, '\\'') END",
))

