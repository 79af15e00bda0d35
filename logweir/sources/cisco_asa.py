"""Firewall messages: ``<pri>Mon d hh:mm:ss host %ASA-sev-code: body``.

Header and body are taken apart by position: the message tag divides the line, and a
body's fields stand at fixed words between the keywords of the vendor's message list::

    Built {inbound|outbound} TCP connection 7 for zone:ip/port (ip/port) to zone:ip/port (ip/port) [(user)]
    Teardown TCP connection 7 for zone:ip/port to zone:ip/port duration h:mm:ss bytes n [reason] [(user)]
    {Built|Teardown} [inbound|outbound] ICMP connection for faddr ip/n gaddr ip/n laddr ip/n
    Deny tcp src zone:ip[/port] dst zone:ip[/port] [(type n, code n)] by access-group "name"
"""

from ..catalogue import SYSLOG_FACILITY_NAME, SYSLOG_SEVERITY_NAME, SYSLOG_SEVERITY_SCALE
from ..functions.sql import after, before, code_table, matches, strip, text
from .spec import SourceSpec

NUMBER, NAT, PLACE = "^[0-9]+$", "^[(][0-9.]+/[0-9]+[)]$", "^[0-9.]+/[0-9]+"
ENDPOINT, OPEN_ENDPOINT = "^[A-Za-z0-9_-]+:[0-9.]+/[0-9]+$", "^[A-Za-z0-9_-]+:[0-9.]+(/[0-9]+)?$"
ICMP_MARK, GROUP_MARK = "ICMP connection for ", ' by access-group "'
#: A user in brackets at the end of what follows the byte count.
LAST_BRACKETS = "[ ]+[(]([^)]+)[)]$"


def _all(*conditions: str) -> str:
    return "coalesce(" + " AND ".join(f"({c})" for c in conditions) + ", false)"


def _keywords(words: str, at: dict[int, str]) -> str:
    """The words at given places."""
    return " AND ".join(f"get({words}, {i}) = {text(w)}" for i, w in at.items())


def _at(words: str, i: int, pattern: str) -> str:
    return matches(f"get({words}, {i})", pattern)


def _zone(end: str) -> str:
    return before(end, ":")


def _address(end: str) -> str:
    """The address of ``zone:ip/port``, ``ip/port`` or ``(ip/port)``."""
    return f"trim(LEADING '(' FROM substring_index(substring_index({end}, ':', -1), '/', 1))"


def _port(end: str) -> str:
    return f"CASE WHEN instr({end}, '/') > 0 THEN rtrim(')', substring_index({end}, '/', -1)) END"


def _from(words: str, first: int) -> str:
    """The words from ``first`` on as text."""
    return f"array_join(slice({words}, {first + 1}, greatest(size({words}) - {first}, 0)), ' ')"


def _pick(**expressions: str) -> str:
    """A field's expression by message variant."""
    return "CASE _variant " + " ".join(f"WHEN '{v}' THEN {e}" for v, e in expressions.items()) + " END"


_IS_BUILT = _all(
    _keywords("_w", {0: "Built", 3: "connection", 5: "for", 8: "to"}), "get(_w, 1) IN ('inbound', 'outbound')",
    "get(_w, 2) IN ('TCP', 'UDP')", _at("_w", 4, NUMBER), _at("_w", 6, ENDPOINT), _at("_w", 7, NAT),
    _at("_w", 9, ENDPOINT), _at("_w", 10, NAT), matches(_from("_w", 11), "^([ ]*[(][^)]+[)])?$"))
_IS_TEARDOWN = _all(
    _keywords("_w", {0: "Teardown", 2: "connection", 4: "for", 6: "to", 8: "duration", 10: "bytes"}),
    "get(_w, 1) IN ('TCP', 'UDP')", _at("_w", 3, NUMBER), _at("_w", 5, ENDPOINT), _at("_w", 7, ENDPOINT),
    _at("_w", 9, "^[0-9]+:[0-9]{2}:[0-9]{2}$"), _at("_w", 11, NUMBER))
_IS_ICMP = _all(
    f"instr(_body, {text(ICMP_MARK)}) > 0", "get(_w, 0) IN ('Built', 'Teardown')",
    "get(_w, 1) = 'ICMP' OR (get(_w, 1) IN ('inbound', 'outbound') AND get(_w, 2) = 'ICMP')",
    _keywords("_i", {0: "faddr", 2: "gaddr", 4: "laddr"}), _at("_i", 1, PLACE + "$"), _at("_i", 3, PLACE + "$"), _at("_i", 5, PLACE))
_IS_DENY = _all(
    _keywords("_d", {0: "Deny", 2: "src", 4: "dst"}), _at("_d", 1, "^[A-Za-z0-9_]+$"), _at("_d", 3, OPEN_ENDPOINT),
    _at("_d", 5, OPEN_ENDPOINT), "size(_d) = 6 OR (size(_d) = 10 AND "
    + _keywords("_d", {6: "(type", 8: "code"}) + " AND " + _at("_d", 7, "^[0-9]+,$") + " AND " + _at("_d", 9, "^[0-9]+[)]$") + ")",
    "instr(_group, '\"') > 1")

SPEC = SourceSpec(
    name="cisco_asa", version="2.0", module="cisco", dataset="cisco.asa", provider="asa",
    observer_vendor="Cisco", observer_product="ASA", observer_type="firewall",
    event_category=("network",), event_type=("info",),
    severity_map=SYSLOG_SEVERITY_SCALE,
    stages=(
        {"_priority": f"substring({before('raw', '>')}, 2)", "_head": before(after("raw", ">"), " %ASA-"),
         "_tag": after("raw", " %ASA-")},
        {"_host": "substring_index(_head, ' ', -1)", "_codes": f"split({before('_tag', ':')}, '-')",
         "_body": f"substring({after('_tag', ':')}, 2)", "_gap": f"left({after('_tag', ':')}, 1)"},
        {"_stamp": "left(_head, greatest(length(_head) - length(_host) - 1, 0))"},
        {"_day": "split(_stamp, '[ \\\\t]+')"},
        {"_ok": _all("startswith(raw, '<')", matches("_priority", NUMBER), "_host <> ''", "size(_day) = 3", "length(get(_day, 0)) = 3",
                     _at("_day", 1, "^[0-9]{1,2}$"), _at("_day", 2, "^[0-9:]{8}$"), "size(_codes) = 2",
                     _at("_codes", 0, "^[0-9]$"), _at("_codes", 1, NUMBER), "_gap IN (' ', '\\t')"),
         "_pri": "try_cast(_priority AS BIGINT)", "_sev": "try_cast(get(_codes, 0) AS BIGINT)",
         "_w": "split(_body, ' ')", "_i": f"split({after('_body', ICMP_MARK)}, ' ')",
         "_d": f"split({before('_body', GROUP_MARK)}, ' ')", "_group": after("_body", GROUP_MARK)},
        {"_variant": "CASE get(_w, 0) "
                     f"WHEN 'Built' THEN CASE WHEN {_IS_BUILT} THEN 'built' WHEN {_IS_ICMP} THEN 'icmp' END "
                     f"WHEN 'Teardown' THEN CASE WHEN {_IS_TEARDOWN} THEN 'teardown' WHEN {_IS_ICMP} THEN 'icmp' END "
                     f"WHEN 'Deny' THEN CASE WHEN {_IS_DENY} THEN 'deny' END END",
         "_rest": strip(_from("_w", 12))},
    ),
    fields={
        "@timestamp": "_stamp",
        "message": "_body",
        "observer.hostname": "_host",
        "host.name": "_host",
        "event.code": "get(_codes, 1)",
        "event.severity": "_sev",
        "event.action": "CASE WHEN _variant = 'icmp' THEN lower(get(_w, 0)) ELSE _variant END",
        "event.type": "CASE WHEN _variant = 'built' OR (_variant = 'icmp' AND get(_w, 0) = 'Built') "
                      "THEN array('connection', 'start') "
                      "WHEN _variant = 'deny' THEN array('connection', 'denied') "
                      "WHEN _variant IS NOT NULL THEN array('connection', 'end') END",
        "event.outcome": "CASE WHEN _variant = 'deny' THEN 'failure' WHEN _variant IS NOT NULL THEN 'success' END",
        "event.duration": _pick(teardown="get(_w, 9)"),
        "event.reason": strip(_pick(teardown=f"nullif(regexp_replace(_rest, {text(LAST_BRACKETS)}, ''), '')")),
        "network.direction": _pick(built="get(_w, 1)", icmp="CASE WHEN get(_w, 1) <> 'ICMP' THEN get(_w, 1) END"),
        "network.transport": _pick(built="get(_w, 2)", teardown="get(_w, 1)", icmp="'icmp'", deny="get(_d, 1)"),
        "network.bytes": _pick(teardown="get(_w, 11)"),
        "source.ip": _pick(built=_address("get(_w, 6)"), teardown=_address("get(_w, 5)"), icmp=_address("get(_i, 1)"), deny=_address("get(_d, 3)")),
        "source.port": _pick(built=_port("get(_w, 6)"), teardown=_port("get(_w, 5)"), deny=_port("get(_d, 3)")),
        "source.nat.ip": _pick(built=_address("get(_w, 7)")),
        "source.nat.port": _pick(built=_port("get(_w, 7)")),
        "destination.ip": _pick(built=_address("get(_w, 9)"), teardown=_address("get(_w, 7)"), icmp=_address("get(_i, 5)"), deny=_address("get(_d, 5)")),
        "destination.port": _pick(built=_port("get(_w, 9)"), teardown=_port("get(_w, 7)"), deny=_port("get(_d, 5)")),
        "destination.nat.ip": _pick(built=_address("get(_w, 10)"), icmp=_address("get(_i, 3)")),
        "destination.nat.port": _pick(built=_port("get(_w, 10)")),
        "observer.ingress.zone": _pick(built=_zone("get(_w, 6)"), teardown=_zone("get(_w, 5)"), deny=_zone("get(_d, 3)")),
        "observer.egress.zone": _pick(built=_zone("get(_w, 9)"), teardown=_zone("get(_w, 7)"), deny=_zone("get(_d, 5)")),
        "user.name": strip(_pick(built=f"nullif(trim(BOTH '() ' FROM {_from('_w', 11)}), '')",
                                 teardown=f"nullif(regexp_extract(_rest, {text(LAST_BRACKETS)}, 1), '')")),
        "rule.name": _pick(deny=before("_group", '"')),
        "log.syslog.priority": "_pri",
        "log.syslog.facility.code": "_pri div 8",
        "log.syslog.facility.name": code_table(SYSLOG_FACILITY_NAME, "_pri div 8"),
        "log.syslog.severity.code": "_sev",
        "log.syslog.severity.name": code_table(SYSLOG_SEVERITY_NAME, "_sev"),
        "connection_id": _pick(built="get(_w, 4)", teardown="get(_w, 3)"),
        "icmp_id": _pick(icmp=_port("get(_i, 1)")),
        "icmp_type": _pick(deny="rtrim(',', get(_d, 7))"),
        "icmp_code": _pick(deny="rtrim(')', get(_d, 9))"),
    },
    error="CASE WHEN NOT _ok THEN 'ValueError:ASA header mismatch' END",
)
