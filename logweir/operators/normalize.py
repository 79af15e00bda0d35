"""Parsed lines to typed, nested event documents that lose nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..catalogue import (EVENT_FIELDS, METADATA_FIELDS, PIPELINE_VERSION, RELATED, SCHEMA_VERSION,
                         SQL_TYPE)
from ..functions.coerce import coerce
from ..functions.sql import code_table, name, text, texts
from ..sources.spec import FIELD, PATHS, SourceSpec, is_field, residual_map, staged, target_of

# What an event needs to carry into normalization.
ENVELOPE = ("raw", "source", "seq", "event_id", "event_hash", "received_at")


def nest(columns: dict[str, str]) -> dict[str, str]:
    """Dotted paths to nested structs: one SQL expression per top-level name.

    ``{"a.b": x, "a.c": y, "m": z}`` gives ``{"a": named_struct('b', x, 'c', y), "m": z}``.
    """
    tree: dict = {}
    for path, e in columns.items():
        level = tree
        *parents, leaf = path.split(".")
        for p in parents:
            level = level.setdefault(p, {})
        level[leaf] = e

    def build(node):
        if isinstance(node, str):
            return node
        return "named_struct(" + ", ".join(f"{text(k)}, {build(v)}" for k, v in node.items()) + ")"

    return {top: build(node) for top, node in tree.items()}


def place_fields(df: DataFrame, spec: SourceSpec, year_hint: int | None = None,
                 now: str = "current_timestamp()", keep: tuple[str, ...] = ()) -> DataFrame:
    """Coerce staged fields and put each at its schema path (columns ``t:<path>``).

    Of several fields for one path the last one that coerces counts. A value
    that does not coerce stays in ``unmapped`` under its own key. A path that the line
    itself names as a key counts before a key that is mapped to it, and behind what the source derives.
    """
    types = dict(df.dtypes)
    by_target: dict[str, list[tuple[str, str]]] = {}
    failed: dict[str, str] = {}
    typed, seen = [], {}
    for column, data_type in types.items():
        if not is_field(column):
            continue
        key = column[len(FIELD):]
        target = target_of(spec, key)
        if target is None:
            continue
        kind = EVENT_FIELDS[target]
        source = f"nullif({name(column)}, '')" if data_type == "string" else name(column)
        passes = (kind in ("keyword", "text") and data_type == "string") or data_type == SQL_TYPE[kind] \
            and kind not in ("date", "ip", "ip[]", "duration")
        if passes:
            out = source
        else:
            out = coerce(kind, name(column), data_type, year_hint, now)
            failed[key] = f"{name('c:' + key)} IS NULL"
        seen[key] = data_type
        typed.append(f"{out} AS {name('c:' + key)}")
        by_target.setdefault(target, []).append(key)
    fields = [name(c) for c in types if c.startswith(FIELD)]
    carried = [name(c) for c in keep]
    named = _named_paths(year_hint, now) if PATHS in types else {}
    df = df.selectExpr(*carried, *fields, *typed, *[f"{e} AS {name(c)}" for c, (_, e) in named.items()])
    at_run_time = {p: c for c, (paths, _) in named.items() for p in paths}
    if named:
        # One look-up code for all, behind one test: few lines name a path.
        found = ", ".join(f"{text(p)}, try_element_at({name(c)}, {text(p)})" for p, c in at_run_time.items())
        df = df.selectExpr("*", f"CASE WHEN {name(PATHS)} IS NOT NULL THEN named_struct({found}) END AS _named")
    placed = []
    for target in [*by_target, *[p for p in at_run_time if p not in by_target]]:
        keys = by_target.get(target, [])
        options = [name("c:" + k) for k in reversed(keys) if k == target]
        if target in at_run_time and target not in keys:
            options.append(f"_named.{name(target)}")
        options += [name("c:" + k) for k in reversed(keys) if k != target]
        e = options[0] if len(options) == 1 else f"coalesce({', '.join(options)})"
        placed.append(f"{e} AS {name('t:' + target)}")
    return df.selectExpr(*carried, *placed, f"{residual_map(df, spec, failed, [name(c) for c in named])} AS unmapped")


def _named_paths(year_hint: int | None, now: str) -> dict[str, tuple[list[str], str]]:
    """Per kind of field: column -> (the paths of that kind, the map of those that a line names and that coerce).

    One expression per kind does for all paths of it, and none runs for a line that names no path.
    """
    out = {}
    for kind in sorted({k for k in EVENT_FIELDS.values() if not k.startswith("object")}):
        paths = [p for p, k in EVENT_FIELDS.items() if k == kind]
        listed = kind.endswith("[]")
        value = coerce(kind, "coalesce(pv.list, array(pv.text))" if listed else "pv.text", "array<string>" if listed else "string", year_hint, now)
        mine = f"map_filter({name(PATHS)}, (pk, pv) -> pk IN ({', '.join(map(text, paths))}) AND pv.text IS NOT NULL)"
        out["n:" + kind] = (paths, f"CASE WHEN {name(PATHS)} IS NOT NULL THEN map_filter(transform_values({mine}, (pk, pv) -> {value}), (pk, pv) -> pv IS NOT NULL) END")
    return out


def normalize(df: DataFrame, spec: SourceSpec, year_hint: int | None = None,
              now: str = "current_timestamp()") -> DataFrame:
    """Lines of one source with their envelope to event documents.

    Lines that fail to parse are left out; :func:`parse_failures` gives those, and
    :func:`parsed` both at once. The result has one column per top-level schema field (structs nest by
    dotted path), ``residual_ns`` and ``unmapped`` for everything without a
    place in the schema, ``event_ts`` as a real timestamp, and ``log_type``.
    """
    df = _with_defaults(df)
    keep = tuple(c for c in (*ENVELOPE, "confidence") if c in df.columns)
    out = place_fields(staged(df, spec).filter("parse_error IS NULL"), spec, year_hint, now, keep)
    return out.selectExpr(*_document(out, spec))


def parsed(df: DataFrame, spec: SourceSpec, year_hint: int | None = None,
           now: str = "current_timestamp()") -> DataFrame:
    """All lines of one source as documents, parsed once: ``reason`` is null for those that parsed.

    ``candidates`` are carried along; a failed line's document holds the line, its ids and
    its source, so that the quarantine needs nothing else.
    """
    df = _with_defaults(df)
    out = place_fields(staged(df, spec, fenced=False), spec, year_hint, now, (*ENVELOPE, "confidence", "candidates", "parse_error"))
    return out.selectExpr(*_document(out, spec), "candidates", "concat('parse_error:', parse_error) AS reason")


def unparsed(df: DataFrame) -> DataFrame:
    """Lines that no source takes, in the shape :func:`parsed` gives; ``reason`` is the one they have."""
    df = _with_defaults(df)
    values = {**_origin(), "pipeline.classification.log_type": "log_type", "pipeline.classification.confidence": "confidence",
              "pipeline.ingest.source": "source", "pipeline.ingest.seq": "seq"}
    return df.selectExpr(*_columns(values), "cast(null AS STRING) AS residual_ns", "cast(null AS MAP<STRING, STRING>) AS unmapped",
                         "cast(null AS TIMESTAMP) AS event_ts", "log_type", "candidates", "reason")


def _with_defaults(df: DataFrame) -> DataFrame:
    missing = {"confidence": "DOUBLE", "candidates": "ARRAY<STRUCT<label: STRING, p: DOUBLE>>"}
    return df.selectExpr("*", *[f"cast(null AS {t}) AS {c}" for c, t in missing.items() if c not in df.columns])


def parse_failures(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """The lines of one source that did not parse, with ``reason`` for the quarantine."""
    carried = [name(c) for c in df.columns if c != "reason"]
    return (staged(df, spec).filter("parse_error IS NOT NULL")
            .selectExpr(*carried, "concat('parse_error:', parse_error) AS reason"))


def _origin() -> dict[str, str]:
    """What every event says of where it came from."""
    return {
        "event.original": "raw", "event.id": "event_id", "event.hash": "event_hash", "event.ingested": "received_at",
        # A source with a scheme is a network address, anything else a file.
        "log.source.address": "CASE WHEN instr(source, '://') > 0 THEN source END",
        "log.file.path": "CASE WHEN instr(source, '://') = 0 THEN source END",
    }


def _columns(values: dict[str, str]) -> list[str]:
    """A document's columns: the values in their places, and typed nulls for every other field."""
    every = {**EVENT_FIELDS, **METADATA_FIELDS}
    typed = {p: values.get(p) or f"cast(null AS {SQL_TYPE[t]})" for p, t in every.items()
             if p != "pipeline.classification.candidates"}
    return [f"{e} AS {name(top)}" for top, e in nest(typed).items()]


def _document(df: DataFrame, spec: SourceSpec) -> list[str]:
    have = {c[2:] for c in df.columns if c.startswith("t:")}

    def got(path):
        return name("t:" + path) if path in have else None

    def default(path, literal):
        """The extracted value, else the source's default."""
        own = got(path)
        return literal if own is None else f"coalesce({own}, {literal})"

    values: dict[str, str] = {p: got(p) for p in EVENT_FIELDS if got(p)}
    values.update({
        **_origin(),
        "@timestamp": default("@timestamp", "received_at"),
        "event.kind": default("event.kind", text(spec.event_kind)),
        "event.category": default("event.category", texts(spec.event_category)),
        "event.type": default("event.type", texts(spec.event_type)),
        "event.outcome": default("event.outcome", "'unknown'"),
        "event.module": text(spec.module), "event.dataset": text(spec.full_dataset),
    })
    for path, literal in (("event.provider", spec.provider), ("observer.vendor", spec.observer_vendor),
                          ("observer.product", spec.observer_product), ("observer.type", spec.observer_type)):
        if literal:
            values[path] = default(path, text(literal))
    if spec.severity_map and got("event.severity"):
        sev = got("event.severity")
        values["event.severity"] = f"coalesce({code_table(spec.severity_map, sev)}, {sev})"
    for path in ("network.transport", "network.protocol", "network.direction"):
        if got(path):
            values[path] = f"lower({got(path)})"
    if got("http.request.method"):
        values["http.request.method"] = f"upper({got('http.request.method')})"
    for path, sources in RELATED.items():
        parts = []
        for p in sources:
            if got(p):
                one = values[p]
                parts.append(f"coalesce({one}, cast(array() AS ARRAY<STRING>))" if EVENT_FIELDS[p].endswith("[]")
                             else f"array({one})")
        if parts:
            values[path] = related(parts)
    values.update({
        "pipeline.schema.version": text(SCHEMA_VERSION), "pipeline.pipeline.version": text(PIPELINE_VERSION),
        "pipeline.parser.name": text(spec.name), "pipeline.parser.version": text(spec.version),
        "pipeline.classification.log_type": text(spec.name),
        "pipeline.classification.confidence": "confidence",
        "pipeline.ingest.source": "source", "pipeline.ingest.seq": "seq",
    })
    ts = values["@timestamp"]
    return [*_columns(values), f"{text(spec.residual_namespace)} AS residual_ns", "unmapped",
            f"CASE WHEN {ts} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T' THEN try_cast({ts} AS TIMESTAMP) END AS event_ts",
            f"{text(spec.name)} AS log_type"]


def related(parts: list[str]) -> str:
    """Distinct sorted values of several array expressions; null when there is none."""
    joined = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    # array_except drops nulls and repeats in one step
    values = f"sort_array(array_except({joined}, array(cast(null AS STRING))))"
    return f"nullif({values}, cast(array() AS ARRAY<STRING>))"
