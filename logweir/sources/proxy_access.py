"""Proxy access log: combined format and an optional quoted list of ``key=value`` words."""

from ..functions.sql import json_text, matches, nil, texts
from ..functions.textual import url_stages
from .access import NOTHING_MORE, REQUEST_FIELDS, request_stages
from .spec import SourceSpec

# --- fixed values: proxy actions and statuses that mean the request was denied ------
DENY_ACTIONS = ("deny", "denied", "block", "blocked", "reject")
DENY_STATUS = (403, 407)
# --- fixed values: words of the list that have a place of their own --------------------
COUNTERS = ("cs_bytes", "sc_bytes", "tunnel_cs_bytes", "tunnel_sc_bytes", "tunnel_duration_ms")


def _value(key):
    """Value of the last word ``key=...`` in the list, null when there is none."""
    prefix = len(key) + 2
    return f"substring(try_element_at(filter(_words, w -> startswith(w, '{key}=')), -1), {prefix})"


def _count(key):
    return f"try_cast(_{key} AS BIGINT)"


_NOT_A_NUMBER = " ".join(
    f"WHEN _{k} IS NOT NULL AND {_count(k)} IS NULL THEN "
    f"concat('ValueError:invalid literal for int() with base 10: \\'', _{k}, '\\'')" for k in COUNTERS)

SPEC = SourceSpec(
    name="proxy_access", version="2.0", module="squid", dataset="squid.access", provider="squid",
    observer_vendor="Squid", observer_product="Squid", observer_type="proxy",
    event_category=("web", "network"), event_type=("access",),
    stages=(
        *request_stages(f"({NOTHING_MORE}) OR (size(_quoted) = 8 AND get(_quoted, 5) = ' ' AND {matches('get(_quoted, 7)', '^[ ]*$')})"),
        {"_user": nil("get(_who, 2)"),
         "_words": "filter(split(coalesce(get(_quoted, 6), ''), '(?U)\\\\s+'), w -> instr(w, '=') > 0)"},
        {"_tunnel": "_method = 'CONNECT'", "_action": _value("proxy_action"),
         **{f"_{k}": _value(k) for k in COUNTERS},
         "_target": "CASE WHEN _method <> 'CONNECT' THEN _url END"},
        *url_stages("_l", "_target"),
        # host:port of a tunnel, cut at the last colon
        {"_host": "CASE WHEN NOT _tunnel THEN _l_host "
                  "ELSE coalesce(nullif(regexp_extract(_url, '^(.*):', 1), ''), _url) END",
         "_port": "CASE WHEN NOT _tunnel THEN nullif(_l_port, 0L) ELSE "
                  "try_cast(regexp_extract(_url, '(?:^|:)([0-9]+)$', 1) AS BIGINT) END",
         "_denied": f"coalesce(lower(_action) IN ({', '.join(map(repr, DENY_ACTIONS))}), false) "
                    f"OR _status IN ({', '.join(map(str, DENY_STATUS))})"},
    ),
    fields={
        **REQUEST_FIELDS,
        "user.domain": "CASE WHEN instr(_user, '\\\\') > 0 THEN regexp_extract(_user, '^(.*)\\\\\\\\', 1) END",
        "user.name": "substring_index(_user, '\\\\', -1)",
        "url.full": "CASE WHEN _l_host IS NOT NULL THEN _url END",
        "url.domain": "_host",
        "url.port": "_port",
        "url.scheme": "CASE WHEN _tunnel THEN 'https' WHEN _l_host IS NOT NULL THEN _l_scheme END",
        "url.path": "CASE WHEN NOT _tunnel THEN coalesce(nullif(_l_path, ''), '/') END",
        "url.query": "_l_query",
        "destination.domain": "_host",
        "network.protocol": "CASE WHEN _tunnel THEN 'ssl' ELSE 'http' END",
        "http.request.bytes": _count("cs_bytes"),
        "http.response.bytes": _count("sc_bytes"),
        "source.bytes": _count("tunnel_cs_bytes"),
        "destination.bytes": _count("tunnel_sc_bytes"),
        "network.bytes": f"CASE WHEN _tunnel_cs_bytes IS NOT NULL OR _tunnel_sc_bytes IS NOT NULL THEN "
                         f"try_add(coalesce({_count('tunnel_cs_bytes')}, 0L), coalesce({_count('tunnel_sc_bytes')}, 0L)) END",
        "event.duration": f"{_count('tunnel_duration_ms')} / 1000D",
        "event.action": "CASE WHEN _action <> '' THEN concat('proxy_', _action) ELSE 'proxy_request' END",
        "event.outcome": "CASE WHEN _denied OR _status >= 400 THEN 'failure' ELSE 'success' END",
        "event.type": "array('access', CASE WHEN _denied THEN 'denied' ELSE 'allowed' END)",
    },
    # Every other word is kept; of a repeated key the last value counts.
    residual=("map_from_entries(transform(array_except(transform(_words, w -> substring_index(w, '=', 1)), "
              f"{texts(('proxy_action', *COUNTERS))}), k -> struct(k, transform(array(substring(try_element_at("
              "filter(_words, w -> startswith(w, concat(k, '='))), -1), length(k) + 2)), v -> "
              f"{json_text('v')})[0])))"),
    error=f"CASE WHEN NOT _ok THEN 'ValueError:proxy access mismatch' {_NOT_A_NUMBER} "
          "WHEN _l_bad AND _l_host IS NOT NULL THEN 'ValueError:invalid port' END",
)
