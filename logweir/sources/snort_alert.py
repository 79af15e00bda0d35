"""IDS fast alerts: ``MM/dd-HH:mm:ss.ffffff [**] [gid:sid:rev] name [**] ... {PROTO} src -> dst``.

The marks ``[**]`` divide an alert into time, signature and traffic; each of these is
divided at its own brackets.
"""

from ..functions.sql import after, before, code_table, matches, strip
from .spec import SourceSpec

# --- fixed values: generator id to rule set, alert priority to the 0-10 scale ------
RULESET = {"1": "snort", "3": "snort-so", "119": "http_inspect", "129": "stream5"}
PRIORITY_SCALE = {1: 9, 2: 6, 3: 3, 4: 1}

_NUMBER = "^[0-9]+$"
_CHECKS = (
    "size(_thirds) = 3",
    matches("_time", "^[0-9]{2}/[0-9]{2}-[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]+$"),
    "startswith(_signature, '[') AND instr(_signature, ']') > 0",
    f"size(_ids) = 3 AND forall(_ids, x -> {matches('x', _NUMBER)})",
    # A classification may stand before the priority, nothing else.
    "size(_notes) = 1 OR (size(_notes) = 2 AND startswith(_notes[0], '[Classification:') AND _class <> '')",
    "startswith(element_at(_notes, -1), '[Priority:')",
    matches("_number", _NUMBER),
    matches("_proto", "^[A-Za-z0-9_]+$"),
    "size(_ends) = 2",
    f"forall(_ends, x -> {matches('x', '^[0-9.]+(:[0-9]+)?$')})",
)

SPEC = SourceSpec(
    name="snort_alert", version="2.0", module="snort", dataset="snort.alert", provider="snort",
    observer_vendor="Snort", observer_product="Snort", observer_type="ids",
    event_kind="alert", event_category=("intrusion_detection",), event_type=("info",),
    severity_map=PRIORITY_SCALE,
    stages=(
        {"_thirds": "split(raw, '[ \\\\t]+[\\\\[][*][*][\\\\]][ \\\\t]+', 3)"},
        {"_time": "get(_thirds, 0)", "_signature": "get(_thirds, 1)", "_traffic": "get(_thirds, 2)"},
        {"_ids": f"split(substring({before('_signature', ']')}, 2), ':')",
         "_title": strip(after("_signature", "]")),
         # Protocol and addresses follow the last brace.
         "_flow": "substring_index(_traffic, '{', -1)"},
        {"_notes": "filter(transform(split(left(_traffic, length(_traffic) - length(_flow) - 1), ']'), "
                   f"x -> {strip('x')}), x -> x <> '')",
         "_proto": before("_flow", "}"),
         "_ends": f"split({strip(after('_flow', '}'))}, '[ \\\\t]+->[ \\\\t]+')"},
        {"_class": f"CASE WHEN size(_notes) = 2 THEN {strip(after('_notes[0]', ':'))} END",
         "_number": strip(after("element_at(_notes, -1)", ":")),
         "_from": "split(get(_ends, 0), ':')", "_to": "split(get(_ends, 1), ':')"},
        {"_ok": f"coalesce({' AND '.join(f'({x})' for x in _CHECKS)}, false)",
         "_gid": "get(_ids, 0)", "_priority": "try_cast(_number AS BIGINT)"},
    ),
    fields={
        "@timestamp": "_time",
        "message": "_title",
        "event.action": "'alert'",
        "event.outcome": "'unknown'",
        "event.severity": "_priority",
        "event.code": "get(_ids, 1)",
        "rule.id": "get(_ids, 1)",
        "rule.version": "get(_ids, 2)",
        "rule.name": "_title",
        "rule.category": "_class",
        "rule.ruleset": f"coalesce({code_table(RULESET, '_gid')}, concat('gid-', _gid))",
        "network.transport": "_proto",
        "source.ip": "get(_from, 0)",
        "source.port": "get(_from, 1)",
        "destination.ip": "get(_to, 0)",
        "destination.port": "get(_to, 1)",
        "gid": "_gid",
        "priority": "_priority",
    },
    error="CASE WHEN NOT _ok THEN 'ValueError:snort fast-format mismatch' END",
)
