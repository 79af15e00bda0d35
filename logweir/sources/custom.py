"""User-supplied sources: a Python ``parse(raw) -> dict`` in place of SQL expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions.sql import name, text
from .spec import FIELD, SourceSpec


def custom_source(parse: Callable[[str], dict], **identity) -> SourceSpec:
    """A source whose fields come from a Python function, run in Arrow batches.

    ``parse`` may raise: the line is then quarantined with the error's class and
    message. Prefer expressions (``SourceSpec(stages=..., fields=...)``) where
    they can say it; they stay inside the JVM.
    """
    return SourceSpec(parse=parse, **identity)


def _reader(parse: Callable[[str], dict]):
    def one(raw: str | None):
        try:
            fields = parse(raw)
            if not isinstance(fields, dict):
                raise TypeError("parse() must return dict")
            present = {k: v for k, v in fields.items() if v is not None and v != ""}
            # Text and JSON values are kept apart, to be told apart again later.
            strings = {k: v for k, v in present.items() if isinstance(v, str)}
            return {"strings": list(strings.items()), "others": [(k, json.dumps(v)) for k, v in present.items() if k not in strings], "error": None}
        except Exception as e:  # a failing line is data, not a failing job
            return {"strings": [], "others": [], "error": f"{type(e).__name__}:{e}"}

    kind = pa.struct([("strings", pa.map_(pa.string(), pa.string())), ("others", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("raw")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(r) for r in raw], kind)], names=[*batch.schema.names, "_p"])

    return run


def staged_python(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """The same columns the expression sources give, from the user's function.

    The function runs in an Arrow stage of its own, which takes the lines with all their columns: no
    filter on its result moves below it, so it is called once a line.
    """
    from ..catalogue import EVENT_FIELDS
    carried = [name(c) for c in df.columns]
    schema = StructType([*df.schema, *StructType.fromDDL("_p struct<strings: map<string, string>, others: map<string, string>, error: string>")])
    parsed = df.mapInArrow(_reader(spec.parse), schema)
    placed = [*EVENT_FIELDS, *[k for k in spec.field_map if k not in EVENT_FIELDS]]

    def read(key):
        path = key if key in EVENT_FIELDS else spec.field_map[key]
        kind = EVENT_FIELDS[path]
        plain = f"coalesce(try_element_at(_p.strings, {text(key)}), try_element_at(_p.others, {text(key)}))"
        if kind in ("keyword[]", "ip[]"):
            listed = f"from_json(try_element_at(_p.others, {text(key)}), 'array<string>')"
            return (f"CASE WHEN try_element_at(_p.others, {text(key)}) LIKE '[%' THEN {listed} "
                    f"WHEN {plain} IS NOT NULL THEN array({plain}) END")
        if kind == "object[]":
            return f"from_json(try_element_at(_p.others, {text(key)}), 'array<struct<data:string,ttl:bigint>>')"
        if kind == "object":
            return f"from_json(try_element_at(_p.others, {text(key)}), 'map<string,string>')"
        return plain

    known = ", ".join(text(k) for k in placed)
    quoted = ("transform_values(_p.strings, (k, v) -> regexp_extract(to_json(array(v)), '(?s)^.(.*).$', 1))")
    rest = f"map_filter(map_concat({quoted}, _p.others), (k, v) -> NOT array_contains(array({known}), k))"
    return parsed.selectExpr(*carried, *[f"{read(k)} AS {name(FIELD + k)}" for k in placed],
                             f"{rest} AS `f:*`", "_p.error AS parse_error")
