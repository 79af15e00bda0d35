"""Lists of records in JSON files, cut into many blocks at any place."""

import json
import random

import pytest

from logweir.sources.scan import read_corpus


def records(rng, n):
    odd = ["}", "{[", '"', "\\", "a,b", "é🙂", "]},{", "\n"]
    out = []
    for i in range(n):
        out.append(rng.choice([
            {"i": i, "t": "".join(rng.choice(odd) for _ in range(rng.randint(0, 6)))},
            {"i": i, "deep": {"x": [{"y": [i, "}"]}, []], "z": {}}}, [i, {"a": [1, {}]}], i, f"text {i} {rng.choice(odd)}", None, {"long": "x" * rng.randint(0, 300)}]))
    return out


@pytest.mark.parametrize("size", [37, 101, 1000, 1 << 20])
def test_records_of_any_block(spark, tmp_path, size):
    rng, want = random.Random(size), []
    made = {"array": records(rng, 120), "indented": records(rng, 60), "member": records(rng, 80), "empty": [], "one": [{"a": 1}]}
    (tmp_path / "array.json").write_text(json.dumps(made["array"], ensure_ascii=False))
    (tmp_path / "indented.json").write_text(json.dumps(made["indented"], indent=2) + "\n")
    (tmp_path / "member.json").write_text(json.dumps({"about": {"n": [1, [2]], "s": "[{"}, "count": 3, "rows": made["member"], "later": [{"no": 1}], "end": {"a": {"b": {"c": "d" * 200}}}}, indent=1))
    (tmp_path / "empty.json").write_text(" [ ]\n")
    (tmp_path / "one.json").write_text('[\n{"a": 1}]')
    (tmp_path / "listless.json").write_text('{\n"a": {"b": 1}\n}')
    lines = [json.dumps({"k": i, "t": "}"}) for i in range(50)]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    (tmp_path / "parts.log").mkdir()
    for k in range(2):
        (tmp_path / "parts.log" / f"part-{k}").write_text(f"line {k}\n")
    for label, rows in made.items():
        want += [(label, json.dumps(r)) for r in rows]
    want += [("listless", json.dumps({"a": {"b": 1}})), *[("lines", x) for x in lines], ("parts", "line 0"), ("parts", "line 1")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [(r.label, r.line) for r in read_corpus(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")

    def same(label, text):
        return label, text if label == "parts" else json.dumps(json.loads(text), sort_keys=True)

    assert sorted(same(*x) for x in got) == sorted(same(*x) for x in want)
