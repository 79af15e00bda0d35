"""Text functions: URL parts, key=value lookup, template masking, perturbation."""

from __future__ import annotations

from dataclasses import dataclass

from .sql import capture, code_table, text

# RFC 3986, appendix B, with the scheme held to its own grammar.
_URL = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def url_stages(prefix: str, url: str) -> list[dict[str, str]]:
    """Column stages that split a URL into ``<prefix>_{scheme,host,port,path,query,bad}``.

    The host is lower case without user info; a missing part is null, except
    the path, which may be empty. ``bad`` tells of an impossible port.
    """
    p = prefix
    return [
        {f"{p}_u": capture(url, _URL, 4)},
        {f"{p}_hp": f"regexp_replace(substring(get({p}_u, 1), 3), '^.*@', '')"},
        {f"{p}_scheme": f"nullif(lower(get({p}_u, 0)), '')",
         f"{p}_host": f"nullif(lower(CASE WHEN {p}_hp LIKE '[%' THEN regexp_extract({p}_hp, '^\\\\[([^]]*)', 1) "
                      f"ELSE substring_index({p}_hp, ':', 1) END), '')",
         f"{p}_pt": f"CASE WHEN {p}_hp LIKE '[%' THEN regexp_extract({p}_hp, '\\\\]:(.*)$', 1) "
                    f"WHEN instr({p}_hp, ':') > 0 THEN substring({p}_hp, instr({p}_hp, ':') + 1) END",
         f"{p}_path": f"get({p}_u, 2)",
         f"{p}_query": f"nullif(get({p}_u, 3), '')"},
        {f"{p}_port": f"CASE WHEN {p}_pt RLIKE '^[0-9]+$' AND try_cast({p}_pt AS BIGINT) <= 65535 "
                      f"THEN try_cast({p}_pt AS BIGINT) END",
         f"{p}_bad": f"coalesce({p}_pt <> '' AND NOT ({p}_pt RLIKE '^[0-9]+$' "
                     f"AND coalesce(try_cast({p}_pt AS BIGINT), 65536L) <= 65535), false)"},
    ]


def kv_last(x: str, key: str) -> str:
    """Value of the last ``key=value`` word in a text, split at the first ``=``."""
    return f"try_element_at(regexp_extract_all({x}, {text('(?:^|(?<=[ \\t]))' + key + '=(\\S*)')}, 1), -1)"


def mask_template(x: str) -> str:
    """The text with its variable parts masked: IPv4, long hex, digits, white space; 160 characters."""
    for pattern, mask in MASKS:
        x = f"regexp_replace({x}, {text(pattern)}, {text(mask)})"
    return f"substring({x}, 1, {TEMPLATE_LENGTH})"


# --- fixed values: masks, in the order they apply ------------------------------
MASKS = (
    ("(?U)\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b", "<IP>"),
    ("(?U)\\b[0-9a-fA-F]{12,}\\b", "<HEX>"),
    ("(?U)\\d+", "<N>"),
    ("(?U)\\s+", " "),
)
TEMPLATE_LENGTH = 160

@dataclass(frozen=True)
class Perturbation:
    """What a perturbed line replaces beside its addresses: literal texts, one pattern of host names, one of epochs."""

    texts: tuple[tuple[str, str], ...] = ()
    hosts: tuple[str, str] | None = None
    epochs: str | None = None
    epoch_range: tuple[int, int] = (1_700_000_000, 1_800_000_000)


def _draw(line: str, seed: int, tag: str, i: str, low: int, high: int) -> str:
    """A number in [low, high], fixed by the line, the seed and a position."""
    digest = f"sha2(concat({line}, ':{seed}:{tag}:', {i}), 256)"
    return f"({low} + conv(substring({digest}, 1, 8), 16, 10)::BIGINT % {high - low + 1})"


def _resubstitute(x: str, line: str, pattern: str, fresh: str) -> str:
    """Replace the i-th match of a pattern by ``fresh`` (SQL over ``i``, counted from 0)."""
    pieces = f"split({x}, {text(pattern)}, -1)"
    return (f"array_join(transform({pieces}, (piece, i) -> "
            f"CASE WHEN i = 0 THEN piece ELSE concat({fresh}, piece) END), '')")


def perturb(x: str, seed: int = 0, rules: Perturbation = Perturbation()) -> str:
    """The line with other addresses, and with what ``rules`` say: dates, hosts, epochs, names.

    Random parts are drawn from a hash of line, seed and position, so a rerun
    or a retried task gives the same text.
    """
    octets = ", ".join(_draw(x, seed, f"ip{n}", "i", 1, 254) for n in range(4))
    out = _resubstitute(x, x, MASKS[0][0], f"concat_ws('.', {octets})")
    for old, new in rules.texts:
        out = f"replace({out}, {text(old)}, {text(new)})"
    if rules.hosts:
        out = f"regexp_replace({out}, {text(rules.hosts[0])}, {text(rules.hosts[1])})"
    if rules.epochs:
        low, high = rules.epoch_range
        out = _resubstitute(out, x, rules.epochs, f"{_draw(x, seed, 'epoch', 'i', low, high)}::STRING")
    return out


__all__ = ["Perturbation", "code_table", "kv_last", "mask_template", "perturb", "url_stages"]
