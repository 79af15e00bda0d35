"""JSON log lines: nested objects become dotted keys, lists stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sql import code_table, name, text


# What a line's JSON object is cast to; null for every other value.
_MEMBERS = "MAP<STRING, VARIANT>"


def _members(v: str) -> str:
    """A nested object's members; null for anything else, which is told by the value's first byte."""
    return f"try_cast({v} AS {_MEMBERS})"


def _unfold(entries: str, most: str) -> str:
    """The entries with nested objects replaced by their members, level by level until none is left.

    ``most`` is a bound on the levels; a line stops at its own last one.
    """
    inner = f"transform(map_entries({_members('e.value')}), c -> named_struct('key', concat(e.key, '.', c.key), 'value', c.value))"
    level = f"flatten(transform(s.es, e -> CASE WHEN {_members('e.value')} IS NULL THEN array(e) ELSE {inner} END))"
    return (f"aggregate(sequence(1, {most}), named_struct('es', {entries}, 'more', true), "
            f"(s, i) -> CASE WHEN NOT s.more THEN s WHEN exists(s.es, e -> {_members('e.value')} IS NOT NULL) "
            f"THEN named_struct('es', {level}, 'more', true) ELSE named_struct('es', s.es, 'more', false) END, s -> s.es)")


def _bound(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` worked out once."""
    return f"transform(array({value}), {variable} -> {body})[0]"


def _unfolded_map(top: str, most: str) -> str:
    """A map's nested objects unfolded. A dotted key and a nested one can meet; then the last one in key order counts.

    Every value is tried once, and a level has only the objects of the one before; the order is restored where keys meet.
    """
    last = ("filter(es, (e, i) -> NOT exists(slice(es, i + 2, greatest(size(es) - i - 1, 0)), "
            "later -> later.key = e.key))")
    ordered = _bound(_unfold(f"map_entries({top})", most), "es", f"map_from_entries({last})")
    tried = f"transform(map_entries({top}), e -> named_struct('key', e.key, 'value', e.value, 'inner', {_members('e.value')}))"
    below = ("flatten(transform(s.todo, t -> transform(map_entries(t.inner), c -> named_struct("
             f"'key', concat(t.key, '.', c.key), 'value', c.value, 'inner', {_members('c.value')}))))")
    step = _bound(below, "b", "named_struct('done', concat(s.done, filter(b, e -> e.inner IS NULL)), 'todo', filter(b, e -> e.inner IS NOT NULL))")
    unfolded = (f"aggregate(sequence(1, {most}), named_struct('done', filter(ts, e -> e.inner IS NULL), 'todo', filter(ts, e -> e.inner IS NOT NULL)), "
                f"(s, i) -> CASE WHEN size(s.todo) = 0 THEN s ELSE {step} END, s -> s.done)")
    whole = (f"CASE WHEN size(array_distinct(transform(es, e -> e.key))) = size(es) "
             f"THEN map_from_arrays(transform(es, e -> e.key), transform(es, e -> e.value)) ELSE {ordered} END")
    return _bound(tried, "ts", _bound(unfolded, "es", whole))


def json_stages(raw: str = "raw") -> tuple[dict[str, str], ...]:
    """Stages that turn a JSON line into ``_f``, a map from dotted key to value.

    ``_f`` has no entry for JSON nulls and is null when the line is not one JSON
    object; ``_json_error`` then says why. Wrapping the line in brackets makes
    the parser see text that follows the object.
    """
    # A bound on the levels of nested objects: the braces behind the first.
    levels = f"length({raw}) - length(replace({raw}, '{{', '')) - 1"
    return (
        {"_list": f"try_parse_json(concat('[', {raw}, ']'))"},
        {"_one": "CASE WHEN variant_get(_list, '$[1]', 'variant') IS NULL "
                 "THEN variant_get(_list, '$[0]', 'variant') END"},
        {"_top": _members("_one"), "_levels": levels},
        {"_flat": f"CASE WHEN _levels < 1 THEN _top WHEN _top IS NOT NULL THEN {_unfolded_map('_top', '_levels')} END",
         "_json_error": "CASE WHEN _one IS NULL THEN 'JSONDecodeError:invalid JSON' WHEN _top IS NULL THEN "
                        "concat('AttributeError:\\'', CASE WHEN is_variant_null(_one) THEN 'NoneType' ELSE "
                        "coalesce(" + code_table({"STRING": "str", "BIGINT": "int", "BOOLEAN": "bool"},
                                                 "schema_of_variant(_one)")
                        + ", CASE WHEN startswith(schema_of_variant(_one), 'ARRAY') THEN 'list' ELSE 'float' END) END, "
                        "'\\' object has no attribute \\'items\\'') END"},
        {"_f": f"CASE WHEN instr({raw}, 'null') > 0 THEN map_filter(_flat, (k, v) -> NOT is_variant_null(v)) ELSE _flat END"},
    )


def value(key: str) -> str:
    """A value as text: strings as they are, numbers and nested values as JSON."""
    return f"try_cast(try_element_at(_f, {text(key)}) AS STRING)"


def json_type(key: str) -> str:
    return f"schema_of_variant(try_element_at(_f, {text(key)}))"


def is_true(key: str) -> str:
    """Truth of a JSON value: false, 0, '' and absent are false."""
    return f"coalesce({value(key)} NOT IN ('false', '0', '0.0', '', '[]'), false)"


def rest(consumed, more: str = "false") -> str:
    """The fields that no expression of the source has taken, as JSON text."""
    keys = ", ".join(text(k) for k in consumed)
    return (f"transform_values(map_filter(_f, (k, v) -> NOT (k IN ({keys}) OR {more})), "
            "(k, v) -> to_json(v))")


def schema_paths(fields) -> str:
    """The entries whose key is itself a path of the event schema, but for ``fields``, which the source computes."""
    from ..catalogue import EVENT_FIELDS
    keys = ", ".join(text(p) for p, kind in EVENT_FIELDS.items() if p not in fields and not kind.startswith("object"))
    return f"map_filter(_f, (k, v) -> k IN ({keys}))"


def flatten_json(df: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``flat``: MAP from dotted key to JSON text; null when the text is no JSON object."""
    carried = [name(c) for c in df.columns]
    helpers: list[str] = []
    for stage in json_stages(name(column)):
        df = df.selectExpr(*carried, *helpers, *[f"{e} AS {name(c)}" for c, e in stage.items()])
        helpers += [name(c) for c in stage]
    # A filter on the result stays above the unfolding (see ``spec.staged``).
    df = df.selectExpr(*carried, "_f", "rand(0) AS _fence")
    return df.selectExpr(*carried, "CASE WHEN _fence < 2 THEN transform_values(_f, (k, v) -> to_json(v)) END AS flat")
