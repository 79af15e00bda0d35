"""Typed coercions. Each takes SQL expression text and returns SQL expression text.

The argument is repeated in the result, so pass a column name or something
cheap. Nothing here raises: a value that does not fit becomes null (or, for
dates, stays as it came), and the caller keeps it among the unmapped fields.
"""

from __future__ import annotations

from .sql import strip, text

ISO_MILLIS = "yyyy-MM-dd\\'T\\'HH:mm:ss.SSSxxx"

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_CLOCK = "(\\d{1,2}):(\\d{1,2}):(\\d{1,2})"

_NUMBER = "^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$"
_OFFSET = "(?:Z|[+-]\\d{2}(?::?\\d{2})?)?"
_ISO = f"^\\d{{4}}-?\\d{{2}}-?\\d{{2}}T\\d{{2}}(?::?\\d{{2}}(?::?\\d{{2}}(?:[.,]\\d+)?)?)?{_OFFSET}$"
_ISO_FULL = f"^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(?:[.,]\\d+)?{_OFFSET}$"
_ISO_PARTS = "^(\\d{4})-?(\\d{2})-?(\\d{2})T(\\d{2}):?(\\d{2})?:?(\\d{2})?"
_ACCESS = f"(?i)^(\\d{{1,2}})/({_MONTH})/(\\d{{4}}):{_CLOCK}\\s+(Z|[+-]\\d{{2}}:?\\d{{2}})$"
_BSD = f"(?i)^({_MONTH})\\s+(\\d{{1,2}})\\s+{_CLOCK}$"
_ALERT = f"^(\\d{{1,2}})/(\\d{{1,2}})-{_CLOCK}\\.(\\d{{1,6}})$"
_PLAIN = f"^(\\d{{4}})[-/](\\d{{1,2}})[-/](\\d{{1,2}})\\s+{_CLOCK}$"
# The usual fixed-width forms, which substrings take apart without further matching.
_ISO_USUAL = "^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(?:\\.\\d+)?(?:Z|[+-]\\d\\d:\\d\\d)$"
_ACCESS_USUAL = f"^\\d\\d/(?i:{_MONTH})/\\d{{4}}:\\d\\d:\\d\\d:\\d\\d [+-]\\d{{4}}$"
_BSD_USUAL = f"^(?i:{_MONTH}) \\d\\d \\d\\d:\\d\\d:\\d\\d$"
_ALERT_USUAL = "^\\d\\d/\\d\\d-\\d\\d:\\d\\d:\\d\\d\\.\\d{1,6}$"
_PLAIN_SEPARATORS = "^\\d{4}(?:-\\d{1,2}-|/\\d{1,2}/)"


def iso_millis(ts: str) -> str:
    """A timestamp as ISO-8601 text, UTC, cut to milliseconds."""
    return f"date_format({ts}, '{ISO_MILLIS}')"


def _month(x: str) -> str:
    return f"lpad((instr('{_MONTHS}', lower({x})) + 2) div 3, 2, '0')"


def _two(x: str) -> str:
    return f"lpad({x}, 2, '0')"


def parse_timestamp(x: str, year_hint: int | None = None, now: str = "current_timestamp()") -> str:
    """Text to TIMESTAMP for the date notations logs use; null if it is none of them.

    Epoch seconds, ISO-8601, access-log, BSD syslog, IDS alert and plain
    date-time. Notations without a year take ``year_hint``, or else the year of
    ``now``, or the year before if that would lie more than a day ahead.
    """
    def group(pattern, i):
        return f"regexp_extract({x}, {text(pattern)}, {i})"

    def clock(pattern, first):
        return " , ':', ".join(_two(group(pattern, i)) for i in range(first, first + 3))

    def dated(rest):
        """``rest`` is everything after the year: '-mm-ddThh:mm:ssZ'."""
        if year_hint is not None:
            return f"try_cast(concat('{int(year_hint):04d}', {rest}) AS TIMESTAMP)"
        this = f"try_cast(concat(year({now}), {rest}) AS TIMESTAMP)"
        last = f"try_cast(concat(year({now}) - 1, {rest}) AS TIMESTAMP)"
        return f"CASE WHEN {this} <= {now} + INTERVAL 1 DAY THEN {this} ELSE {last} END"

    # ISO-8601 in full needs at most its offset completed; short and basic forms are filled in first.
    filled = (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, "
              f"{text(_ISO_PARTS)}, '$1-$2-$3T$4:$5:$6'), ':+(?=[.,Z+-]|$)', ''), "
              f"'T(\\\\d\\\\d)(?!:)', 'T$1:00'), 'T(\\\\d\\\\d:\\\\d\\\\d)(?!:)', 'T$1:00')")
    iso = f"CASE WHEN {x} RLIKE {text(_ISO_FULL)} THEN {x} ELSE {filled} END"
    iso = f"regexp_replace(replace({iso}, ',', '.'), '(T.*[+-]\\\\d\\\\d)(?::?(\\\\d\\\\d))?$', '$1:$2')"
    iso = f"regexp_replace({iso}, '([+-]\\\\d\\\\d):$', '$1:00')"
    iso_text = f"concat({iso}, CASE WHEN {x} RLIKE 'T[^Z+-]*$' THEN 'Z' ELSE '' END)"
    access = (f"concat({group(_ACCESS, 3)}, '-', {_month(group(_ACCESS, 2))}, '-', {_two(group(_ACCESS, 1))}, 'T', "
              f"{clock(_ACCESS, 4)}, CASE WHEN upper({group(_ACCESS, 7)}) = 'Z' THEN 'Z' "
              f"ELSE concat(left({group(_ACCESS, 7)}, 3), ':', right({group(_ACCESS, 7)}, 2)) END)")
    bsd = f"'-', {_month(group(_BSD, 1))}, '-', {_two(group(_BSD, 2))}, 'T', {clock(_BSD, 3)}, 'Z'"
    alert = (f"'-', {_two(group(_ALERT, 1))}, '-', {_two(group(_ALERT, 2))}, 'T', {clock(_ALERT, 3)}, "
             f"'.', {group(_ALERT, 6)}, 'Z'")
    plain = (f"concat({group(_PLAIN, 1)}, '-', {_two(group(_PLAIN, 2))}, '-', {_two(group(_PLAIN, 3))}, 'T', "
             f"{clock(_PLAIN, 4)}, 'Z')")

    def cut(start, length):
        return f"substring({x}, {start}, {length})"

    access_usual = (f"concat({cut(8, 4)}, '-', {_month(cut(4, 3))}, '-', {cut(1, 2)}, 'T', {cut(13, 8)}, "
                    f"{cut(22, 3)}, ':', {cut(25, 2)})")
    bsd_usual = f"'-', {_month(cut(1, 3))}, '-', {cut(5, 2)}, 'T', {cut(8, 8)}, 'Z'"
    alert_usual = f"'-', {cut(1, 2)}, '-', {cut(4, 2)}, 'T', {cut(7, 15)}, 'Z'"
    return (
        f"CASE WHEN {x} RLIKE {text(_ISO_USUAL)} THEN try_cast({x} AS TIMESTAMP) "
        f"WHEN {x} RLIKE {text(_ACCESS_USUAL)} THEN try_cast({access_usual} AS TIMESTAMP) "
        f"WHEN {x} RLIKE {text(_BSD_USUAL)} THEN {dated(bsd_usual)} "
        f"WHEN {x} RLIKE {text(_ALERT_USUAL)} THEN {dated(alert_usual)} "
        f"WHEN {x} RLIKE {text(_NUMBER)} THEN "
        f"CASE WHEN try_cast({x} AS DOUBLE) > 1e9D AND try_cast({x} AS DOUBLE) < 1e11D THEN {epoch_timestamp(f'try_cast({x} AS DOUBLE)')} END "
        f"WHEN {x} RLIKE {text(_ISO)} THEN try_cast({iso_text} AS TIMESTAMP) "
        f"WHEN {x} RLIKE {text(_ACCESS)} THEN try_cast({access} AS TIMESTAMP) "
        f"WHEN {x} RLIKE {text(_BSD)} THEN {dated(bsd)} "
        f"WHEN {x} RLIKE {text(_ALERT)} THEN {dated(alert)} "
        f"WHEN {x} RLIKE {text(_PLAIN)} AND {x} RLIKE {text(_PLAIN_SEPARATORS)} THEN try_cast({plain} AS TIMESTAMP) END")


def bare(x: str) -> str:
    """Text without the white space around it."""
    return f"btrim({x}, ' \\t\\n\\r')"


def epoch_timestamp(x: str) -> str:
    """Epoch seconds (double) to TIMESTAMP, rounded to the microsecond."""
    return f"timestamp_micros(try_cast(rint({x} * 1e6D) AS BIGINT))"


def coerce_timestamp(x: str, year_hint: int | None = None, now: str = "current_timestamp()") -> str:
    """Date text to ISO-8601 UTC milliseconds; text that is no date passes unchanged."""
    return f"coalesce({iso_millis(parse_timestamp(bare(x), year_hint, now))}, nullif({x}, ''))"


def coerce_epoch(x: str) -> str:
    """A JSON number holding epoch seconds to ISO-8601 UTC milliseconds."""
    return iso_millis(epoch_timestamp(x))


def coerce_duration_ns(x: str) -> str:
    """Seconds, or ``H:MM:SS`` / ``MM:SS``, to whole nanoseconds (cut, not rounded)."""
    def part(i):
        return f"try_cast(try_element_at(split({x}, ':'), -{i}) AS BIGINT)"
    hours = f"CASE WHEN size(split({x}, ':')) > 2 THEN {part(3)} ELSE 0L END"
    # A duration beyond the range of a long is null, as any other text that is none.
    seconds = f"try_add(try_add(try_multiply({hours}, 3600L), try_multiply({part(2)}, 60L)), {part(1)})"
    return (f"CASE WHEN instr({x}, ':') > 0 THEN try_multiply({seconds}, 1000000000L) "
            f"WHEN {x} RLIKE {text(_NUMBER)} THEN {seconds_to_ns(f'try_cast({x} AS DOUBLE)')} END")


def seconds_to_ns(x: str) -> str:
    return f"try_cast({x} * 1e9D AS BIGINT)"


def coerce_long(x: str) -> str:
    """Whole number, or a decimal cut towards zero; anything else is null."""
    b = bare(x)
    return f"coalesce(try_cast({x} AS BIGINT), CASE WHEN {b} RLIKE {text(_NUMBER)} THEN try_cast(try_cast({b} AS DOUBLE) AS BIGINT) END)"


def coerce_double(x: str) -> str:
    b = bare(x)
    return f"CASE WHEN {b} RLIKE {text(_NUMBER)} THEN try_cast({b} AS DOUBLE) END"


def coerce_bool(x: str) -> str:
    return f"lower({x}) IN ('1', 'true', 't', 'yes')"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"{_OCTET}(?:\\.{_OCTET}){{3}}"
_H16 = "[0-9a-f]{1,4}"


def _ipv6(s: str) -> str:
    """Canonical IPv6 text (RFC 5952 zero compression), null if it is none.

    Works step by step on a one-element array, so only addresses that contain a
    colon pay for it and the surrounding code stays small.
    """
    address = f"lower(substring_index({s}, '%', 1))"
    tail = "regexp_extract(a, '[^:]*$', 0)"
    octet = [f"cast(get(split({tail}, '[.]'), {i}) AS INT)" for i in range(4)]
    hexed = (f"CASE WHEN a RLIKE {text(':' + _V4 + '$')} THEN concat(regexp_replace(a, '[^:]*$', ''), "
             f"lower(hex({octet[0]} * 256 + {octet[1]})), ':', lower(hex({octet[2]} * 256 + {octet[3]}))) ELSE a END")
    run = f"(?:{_H16}(?::{_H16})*)?"
    have = "size(filter(split(a, ':'), g -> g <> ''))"
    full = (f"CASE WHEN a RLIKE {text(f'^{_H16}(?::{_H16}){{7}}$')} THEN a "
            f"WHEN a RLIKE {text(f'^{run}::{run}$')} AND {have} < 8 THEN concat_ws(':', "
            f"nullif(substring_index(a, '::', 1), ''), substring(repeat(':0', 8 - {have}), 2), "
            f"nullif(substring_index(a, '::', -1), '')) END")
    short = "regexp_replace(a, '(^|:)0{1,3}(?=[0-9a-f])', '$1')"
    zeros = [(f"^(?:(.*?):)??0(?::0){{{k - 1}}}(?::(.*))?$") for k in range(8, 1, -1)]
    packed = "CASE " + " ".join(
        f"WHEN a RLIKE {text(z)} THEN regexp_replace(a, {text(z)}, '$1::$2')" for z in zeros) + " ELSE a END"
    steps = f"array({address})"
    for step in (hexed, full, short, packed):
        steps = f"transform({steps}, a -> {step})"
    zone = f"CASE WHEN instr({s}, '%') > 0 THEN concat('%', substring_index({s}, '%', -1)) ELSE '' END"
    return f"CASE WHEN {s} RLIKE '^[^%]+(?:%[^%]+)?$' THEN concat(get({steps}, 0), {zone}) END"


def coerce_ip(x: str) -> str:
    """A valid IPv4 address, or IPv6 in canonical form; anything else is null."""
    s = strip(x)
    v4 = text("^" + _V4 + "$")
    return (f"CASE WHEN {x} RLIKE {v4} THEN {x} WHEN instr({x}, ':') > 0 THEN {_ipv6(s)} "
            f"WHEN {s} RLIKE {v4} THEN {s} END")


def coerce_ip_list(x: str) -> str:
    """The valid addresses of an array; null when there is none."""
    good = f"filter(transform({x}, v -> {coerce_ip('v')}), v -> v IS NOT NULL)"
    return f"CASE WHEN size({good}) > 0 THEN {good} END"


def coerce(kind: str, x: str, data_type: str, year_hint: int | None = None,
           now: str = "current_timestamp()") -> str:
    """Coerce ``x``, a column of Spark type ``data_type``, to a catalogue type."""
    if data_type == "variant":
        raise TypeError("read variant values as text or number first")
    numeric = data_type in ("bigint", "int", "double") or data_type.startswith("decimal")
    array = data_type.startswith("array")
    if kind == "date":
        return coerce_epoch(x) if numeric else coerce_timestamp(x, year_hint, now)
    if kind == "duration":
        return seconds_to_ns(f"cast({x} AS DOUBLE)") if numeric else coerce_duration_ns(x)
    if kind == "long":
        return f"try_cast({x} AS BIGINT)" if numeric else coerce_long(x)
    if kind == "float":
        return f"cast({x} AS DOUBLE)" if numeric else coerce_double(x)
    if kind == "boolean":
        return f"{x} <> 0" if numeric else coerce_bool(x)
    if kind == "ip":
        return coerce_ip(f"cast({x} AS STRING)" if numeric else x)
    if kind == "ip[]":
        return coerce_ip_list(x if array else f"array({x})")
    if kind == "keyword[]":
        return x if array else f"CASE WHEN {x} IS NOT NULL THEN array(cast({x} AS STRING)) END"
    if kind in ("object[]", "object"):
        return x
    return f"to_json({x})" if array or data_type.startswith(("map", "struct")) else f"cast({x} AS STRING)"
