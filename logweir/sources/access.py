"""Combined access-log lines, shared by the web-server and the proxy source.

A line is taken apart by its delimiters: ``] "`` ends the part before the request, two
spaces divide the request, and quotes divide what follows it::

    client ident user [time] "METHOD url HTTP/version" status bytes "referrer" "agent"
"""

from ..functions.sql import after, before, matches

REQUEST_FIELDS = {
    "@timestamp": "_time",
    "source.ip": "get(_who, 0)",
    "ident": "nullif(get(_who, 1), '-')",
    "http.request.method": "_method",
    "http.version": "substring(get(_quoted, 0), 6)",
    "http.response.status_code": "_status",
    "http.response.body.bytes": "CASE WHEN get(_answer, 2) = '-' THEN '0' ELSE get(_answer, 2) END",
    "http.request.referrer": "nullif(nullif(get(_quoted, 2), '-'), '')",
    "user_agent.original": "nullif(nullif(get(_quoted, 4), '-'), '')",
    "url.original": "_url",
    "network.transport": "'tcp'",
    "message": "concat(_method, ' ', _url, ' ', _status)",
}

#: The combined format ends after the agent.
NOTHING_MORE = "size(_quoted) = 6 AND " + matches("get(_quoted, 5)", r"^\s*$")


def request_stages(ending: str) -> tuple[dict[str, str], ...]:
    """``_who, _time, _method, _url, _status`` and ``_ok``; ``ending`` says what may follow the agent."""
    ok = [
        "instr(raw, '] \"') > 0",
        "size(_who) = 3", f"forall(_who, x -> {matches('x', '^[^ ]+$')})",
        "_time <> ''", "instr(_time, ']') = 0",
        matches("_method", "^[A-Z]+$"), "_url <> ''",
        matches("get(_quoted, 0)", "^HTTP/[0-9.]+$"),
        "size(_answer) = 4", "get(_answer, 0) = ''", "get(_answer, 3) = ''",
        matches("get(_answer, 1)", "^[0-9]{3}$"), matches("get(_answer, 2)", "^(-|[0-9]+)$"),
        "get(_quoted, 3) = ' '", ending,
    ]
    return (
        {"_front": before("raw", '] "'), "_request": f"split({after('raw', '] ' + chr(34))}, ' ', 3)"},
        {"_who": f"split({before('_front', ' [')}, ' ')", "_time": after("_front", " ["),
         "_method": "get(_request, 0)", "_url": "get(_request, 1)", "_quoted": "split(get(_request, 2), '\"', -1)"},
        {"_answer": "split(get(_quoted, 1), ' ')"},
        {"_ok": f"coalesce({' AND '.join(f'({x})' for x in ok)}, false)",
         "_status": "try_cast(get(_answer, 1) AS BIGINT)"},
    )
