"""Web-server access log (combined format)."""

from ..functions.sql import nil
from ..functions.textual import url_stages
from .access import NOTHING_MORE, REQUEST_FIELDS, request_stages
from .spec import SourceSpec

SPEC = SourceSpec(
    name="web_access", version="2.0", module="apache", dataset="apache.access", provider="apache",
    observer_vendor="Apache", observer_product="httpd", observer_type="web-server",
    event_category=("web",), event_type=("access",),
    stages=(
        *request_stages(NOTHING_MORE),
        *url_stages("_l", "_url"),
    ),
    fields={
        **REQUEST_FIELDS,
        "user.name": nil("get(_who, 2)"),
        "url.path": "coalesce(nullif(_l_path, ''), _url)",
        "url.query": "_l_query",
        "url.domain": "_l_host",
        "url.scheme": "CASE WHEN _l_host IS NOT NULL THEN _l_scheme END",
        "url.full": "CASE WHEN _l_host IS NOT NULL THEN _url END",
        "network.protocol": "'http'",
        "event.action": "'http_request'",
        "event.outcome": "CASE WHEN _status < 400 THEN 'success' ELSE 'failure' END",
        "event.type": "CASE WHEN _status IN (401, 403) THEN array('access', 'denied') "
                      "WHEN _status >= 500 THEN array('access', 'error') ELSE array('access') END",
    },
    error="CASE WHEN NOT _ok THEN 'ValueError:apache combined mismatch' END",
)
