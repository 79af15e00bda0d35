"""What a log source is: identity, defaults, and how its fields are computed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import json_text, name, text

# Extracted fields are carried as columns with this prefix until they are placed.
FIELD = "f:"
# Columns with the fields known only at run time: those without a place, and those named by a schema path.
REST, PATHS = FIELD + "*", FIELD + "+"


@dataclass(frozen=True)
class SourceSpec:
    """A log source.

    ``stages`` are groups of helper columns computed one after the other from
    ``raw``; ``fields`` are SQL expressions over those columns, keyed by an
    event-schema path or a name of the source's own; ``error`` is null for a
    line that parsed, else ``<error class>:<message>``. ``residual`` is an
    optional map of further fields (JSON text values) known only at run time;
    ``paths`` one from schema paths that a line itself names to VARIANT values.

    A source may give a Python function ``parse(raw) -> dict`` in place of the
    expressions (see :mod:`logweir.sources.custom`).
    """

    name: str
    version: str = "1.0"
    module: str = "generic"
    dataset: str = ""
    provider: str = ""
    observer_vendor: str = ""
    observer_product: str = ""
    observer_type: str = ""
    event_kind: str = "event"
    event_category: tuple[str, ...] = ("network",)
    event_type: tuple[str, ...] = ("info",)
    field_map: dict[str, str] = field(default_factory=dict)
    severity_map: dict[int, int] = field(default_factory=dict)
    stages: tuple[dict[str, str], ...] = ()
    fields: dict[str, str] = field(default_factory=dict)
    residual: str | None = None
    paths: str | None = None
    error: str = "cast(null AS STRING)"
    parse: Callable[[str], dict] | None = None
    #: Lines of the source that have to parse before it is used in a run.
    samples: tuple[str, ...] = ()

    @property
    def full_dataset(self) -> str:
        return self.dataset or f"{self.module}.{self.name}"

    @property
    def residual_namespace(self) -> str:
        """Where unmapped fields go: module, then what follows the dataset's first dot."""
        head, dot, tail = self.full_dataset.partition(".")
        return f"{self.module}.{tail if dot else self.name}"

    def with_changes(self, **changes) -> "SourceSpec":
        return replace(self, **changes)


def staged(df: DataFrame, spec: SourceSpec, fenced: bool = True) -> DataFrame:
    """The lines with every extracted field as a column ``f:<key>``, plus ``parse_error``.

    ``fenced``: a filter on ``parse_error`` follows in the same plan.
    """
    if spec.parse is not None:
        from .custom import staged_python
        return staged_python(df, spec)
    carried = [name(c) for c in df.columns]
    helpers: list[str] = []
    for stage in spec.stages:
        df = df.selectExpr(*carried, *helpers, *[f"{e} AS {name(c)}" for c, e in stage.items()])
        helpers += [name(c) for c in stage]
    # A filter on parse_error must not move below the stages: the optimizer would
    # write every stage out again inside the condition and run its patterns twice.
    # It never moves below a column that is not deterministic.
    if fenced:
        df = df.selectExpr(*carried, *helpers, "rand(0) AS _fence")
    fields = [f"{e} AS {name(FIELD + key)}" for key, e in spec.fields.items()]
    extra = [f"{spec.residual} AS {name(REST)}"] if spec.residual else []
    if spec.paths:
        # As text and, where it is one, as a list.
        value = ("named_struct('text', nullif(try_cast(pv AS STRING), ''), 'list', "
                 "CASE WHEN startswith(schema_of_variant(pv), 'ARRAY') THEN try_cast(pv AS ARRAY<STRING>) END)")
        extra.append(f"CASE WHEN size({spec.paths}) > 0 THEN transform_values({spec.paths}, (pk, pv) -> {value}) END AS {name(PATHS)}")
    error = f"CASE WHEN _fence < 2 THEN ({spec.error}) END" if fenced else f"({spec.error})"
    return df.selectExpr(*carried, *fields, *extra, f"{error} AS parse_error")


def extract(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Parse ``raw``: adds ``fields`` (STRUCT), ``unmapped`` (MAP) and ``parse_error``.

    ``unmapped`` holds, as JSON text, the fields without a place in the schema.
    Fields of a failed line are null.
    """
    out = staged(df, spec)
    carried = [name(c) for c in df.columns]
    keys = [c[len(FIELD):] for c in out.columns if is_field(c)]
    members = ", ".join(f"{text(k)}, {name(FIELD + k)}" for k in keys)
    return out.selectExpr(*carried, f"named_struct({members}) AS fields",
                          f"{residual_map(out, spec)} AS unmapped", "parse_error")


def is_field(column: str) -> bool:
    """Is it the column of one extracted field?"""
    return column.startswith(FIELD) and column not in (REST, PATHS)


def target_of(spec: SourceSpec, key: str) -> str | None:
    """Schema path a field goes to: its own name if that is a path, else the source's map."""
    from ..catalogue import EVENT_FIELDS
    return key if key in EVENT_FIELDS else spec.field_map.get(key)


def as_json(x: str, data_type: str) -> str:
    """Any extracted value as JSON text."""
    if data_type == "string":
        return f"CASE WHEN {x} <> '' THEN {json_text(x)} END"
    if data_type.startswith(("array", "struct", "map", "variant")):
        return f"to_json({x})"
    return f"cast({x} AS STRING)"


def residual_map(staged_df: DataFrame, spec: SourceSpec, failed: dict[str, str] | None = None, placed: list[str] | None = None) -> str:
    """The map of unmapped fields, with fields that failed coercion back under their own key.

    ``failed`` gives, per field key, the SQL condition under which the field
    could not be coerced; ``placed`` are maps whose keys a line named itself and that have found their place.
    """
    types = dict(staged_df.dtypes)
    own, back = [], []
    for column, data_type in types.items():
        if not is_field(column):
            continue
        key = column[len(FIELD):]
        value = as_json(name(column), data_type)
        if target_of(spec, key) is None:
            own.append((key, value))
        elif failed and key in failed:
            # A missing value did not fail.
            back.append((key, f"{name(column)} IS NOT NULL AND {failed[key]}", value))
    own = _present_entries(own)
    if back:
        # Failed coercions are rare; the map is only widened for lines that have one.
        some = " OR ".join(f"({condition})" for _, condition, _ in back)
        more = _present_entries([(k, f"CASE WHEN {condition} THEN {v} END") for k, condition, v in back])
        own = f"CASE WHEN {some} THEN map_concat({own}, {more}) ELSE {own} END"
    if REST not in types:
        return own
    rest = name(REST)
    if placed:
        found = " OR ".join(f"coalesce(map_contains_key({m}, k), false)" for m in placed)
        rest = f"CASE WHEN {name(PATHS)} IS NOT NULL THEN map_filter({rest}, (k, v) -> NOT ({found})) ELSE {rest} END"
    # Fields found at run time win over declared ones of the same name; none is lost.
    extra = (f"map_filter(coalesce({rest}, cast(map() AS MAP<STRING, STRING>)), "
             "(k, v) -> v IS NOT NULL AND v <> '\"\"')")
    return f"map_concat(map_filter({own}, (k, v) -> NOT coalesce(map_contains_key({rest}, k), false)), {extra})"


def _present_entries(entries: list[tuple[str, str]]) -> str:
    """A map of the entries whose value is not null."""
    if not entries:
        return "cast(map() AS MAP<STRING, STRING>)"
    pairs = ", ".join(f"{text(k)}, {v}" for k, v in entries)
    return f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)"


def source_specs(spark: SparkSession, specs) -> DataFrame:
    """The source definitions as a table, keyed by ``log_type``."""
    rows = [(s.name, s.version, s.module, s.full_dataset, s.provider, s.observer_vendor,
             s.observer_product, s.observer_type, s.event_kind, list(s.event_category),
             list(s.event_type), dict(s.field_map), s.residual_namespace) for s in specs]
    return spark.createDataFrame(rows, (
        "log_type string, parser_version string, module string, dataset string, provider string, "
        "observer_vendor string, observer_product string, observer_type string, event_kind string, "
        "event_category array<string>, event_type array<string>, field_map map<string,string>, "
        "residual_ns string"))
