"""Nested JSON lines become dotted keys, in the order that decides where keys meet."""

import json

from logweir.sources import flatten_json
from logweir.sources.json_lines import json_stages

LINES = {
    '{"a": 1, "b": {"c": 2, "d": {"e": "x{"}}, "l": [{"m": 1}]}': {"a": "1", "b.c": "2", "b.d.e": '"x{"', "l": '[{"m":1}]'},
    '{"a": {"b": {"c": 1}, "b.c": 2}}': {"a.b.c": "2"},
    '{"a": {"b": {"c": 1}, "b.c": 2}, "a.b": {"c": 3}}': {"a.b.c": "3"},
    '{"a.b.c": 4, "a.b": {"c": 3}, "a": {"b": {"c": 1}}, "z": {"y": 5}}': {"a.b.c": "4", "z.y": "5"},
    # A null that comes last counts, and has no entry.
    '{"a": {"b": 1}, "a.b": null, "c": 2}': {"c": "2"},
    '{"a": {}, "b": {"c": {}}, "d": "{"}': {"d": '"{"'},
    '  {"a": 1}': {"a": "1"}, "{}": {}, "[{}]": None, "{": None, '{"a": 1} {"b": 2}': None, None: None,
}


def test_flat_maps(spark):
    df = flatten_json(spark.createDataFrame([(line,) for line in LINES], "raw string"))
    for line, flat in df.select("raw", "flat").collect():
        assert (flat if flat is None else {k: json.loads(v) for k, v in flat.items()}) == (
            None if LINES[line] is None else {k: json.loads(v) for k, v in LINES[line].items()}), line


def test_a_value_is_tried_once_and_its_type_not_spelled_out():
    flat = next(stage["_flat"] for stage in json_stages() if "_flat" in stage)
    assert "schema_of_variant" not in flat
