"""Small helpers that write Spark SQL expression text.

The extraction and coercion formulas are kept as SQL text: one parse per
formula builds the whole Catalyst tree, where the Column API would need a
driver-to-JVM round trip for every operator.
"""

from __future__ import annotations

# A control character that separates captured groups inside one string.
SEP = "\u0001"

# Characters that count as white space, so that trimming follows Unicode.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
              "         　")


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(path: str) -> str:
    """A quoted column name (dots are part of the name)."""
    return "`" + path.replace("`", "``") + "`"


def texts(values) -> str:
    """A SQL array<string> literal."""
    values = list(values)
    if not values:
        return "cast(array() as array<string>)"
    return "array(" + ", ".join(text(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"trim(BOTH {text(WHITESPACE)} FROM {x})"


def nil(x: str) -> str:
    """The usual log notation for "no value"."""
    return f"nullif(nullif({x}, '-'), '')"


def code_table(mapping: dict, key: str) -> str:
    """Look a code up in a small fixed table; null when it is not there."""
    def literal(v):
        return text(v) if isinstance(v, str) else f"{v}L"
    if list(mapping) == list(range(len(mapping))):
        return f"get(array({', '.join(literal(v) for v in mapping.values())}), try_cast({key} AS INT))"
    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
    return f"CASE {key} {arms} END"


def capture(x: str, pattern: str, groups: int) -> str:
    """All groups of one anchored pattern as an array, in a single regex pass.

    Rewriting the line to its groups joined by a separator and splitting that
    costs one match per line however many groups there are. A line that holds
    the separator itself is matched group by group instead. No match gives an
    array that is not ``groups`` long.
    """
    if groups < 2:
        raise ValueError("capture needs two groups or more")
    rewritten = text(SEP.join(f"${i}" for i in range(1, groups + 1)))
    p = text(pattern)
    return (f"CASE WHEN instr({x}, '{SEP}') = 0 "
            f"THEN split(regexp_replace({x}, {p}, {rewritten}), '{SEP}', -1) "
            f"WHEN {x} RLIKE {p} "
            f"THEN transform(sequence(1, {groups}), i -> regexp_extract({x}, {p}, i)) "
            f"ELSE array('') END")


def matches(x: str, pattern: str) -> str:
    return f"{x} RLIKE {text(pattern)}"


def before(x: str, mark: str) -> str:
    """What stands before the first ``mark``; all of it when there is none."""
    return f"substring_index({x}, {text(mark)}, 1)"


def after(x: str, mark: str) -> str:
    """What stands after the first ``mark``; empty when there is none."""
    return f"CASE WHEN instr({x}, {text(mark)}) = 0 THEN '' ELSE substring({x}, instr({x}, {text(mark)}) + {len(mark)}) END"


def leading(x: str, pattern: str) -> str:
    """The part at the start of ``x`` that fits ``pattern``, null when none does."""
    return f"nullif(regexp_extract({x}, {text('^' + pattern)}, 0), '')"


def json_text(x: str) -> str:
    """A string value written as JSON text (quoted and escaped); null stays null."""
    return f"CASE WHEN {x} IS NOT NULL THEN regexp_extract(to_json(array({x})), '(?s)^.(.*).$', 1) END"
