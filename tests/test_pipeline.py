"""Whole runs on small files: numbering, routing, conservation, batch against stream."""

import json
import math
import os
from collections import Counter

import numpy as np
import pytest

from logweir.operators import review
from logweir.operators.classify import LogTypeModel, train
from logweir.operators.normalize import normalize
from logweir.functions import gramwise
from logweir.operators.classify import classify, term_statistics, tfidf_terms
from logweir.operators.ranking import largest, number_all, split_at
from logweir.plans import pipeline
from logweir.plans.pipeline import run_batch
from logweir.sources import SOURCES, SourceSpec, custom_source, extract, flatten_json
from logweir.sources.scan import read_lines
from logweir.sources.sinks import sized
from logweir.streaming import committed, normalize_batch, stream_normalize, stream_totals

WEB = '10.0.0.{i} - - [14/May/2024:12:05:14 +0000] "GET /p{i} HTTP/1.1" 200 7 "-" "agent"'
SYSLOG = "<86>1 2024-05-14T12:00:39Z WEB-{i} sshd 4{i} - - pam_unix(sshd:session): session closed for user u{i}"


def test_numbering_over_many_splits(spark, tmp_path):
    expected = set()
    for f in range(3):
        rows = ["" if i % 7 == 3 else ("  " if i % 11 == 5 else f"file {f} line {i} {'x' * (i % 50)}") for i in range(400)]
        (tmp_path / f"in {f}.log").write_bytes("\r\n".join(rows).encode() + (b"\n" if f else b""))
        expected |= {(f"{tmp_path}/in {f}.log", i + 1, r) for i, r in enumerate(rows) if r.strip()}
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "bad.log").write_bytes(b"ok \xff\xfe end\n")
    expected.add((f"{tmp_path}/bad.log", 1, "ok �� end"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = read_lines(spark, [str(tmp_path)])
        assert lines.rdd.getNumPartitions() > 10
        assert {(r.source, r.seq, r.raw) for r in lines.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.fixture(scope="module")
def model(spark) -> LogTypeModel:
    rows = [("web_access", WEB.format(i=i)) for i in range(40)] + [("syslog", SYSLOG.format(i=i)) for i in range(40)]
    return train(spark.createDataFrame(rows, "label string, line string"))


def test_run(spark, tmp_path, model):
    lines = [WEB.format(i=1), "", SYSLOG.format(i=2), "zzz qqq", WEB.format(i=3).replace("HTTP/1.1", "HTTP/x")]
    (tmp_path / "mixed.log").write_text("\n".join(lines) + "\n")
    model.save(f"{tmp_path}/model")
    loaded = LogTypeModel.load(spark, f"{tmp_path}/model")
    result = run_batch(spark, [str(tmp_path / "mixed.log")], f"{tmp_path}/out", loaded, threshold=0.8, parquet=True)
    m = result.summary.first()
    assert (m.events_total, m.normalized, m.quarantined, m.success_rate) == (4, 2, 2, 0.5)
    assert m.per_type_ok == {"web_access": 1, "syslog": 1} and m.source_errors == {} and m.missing_sources == []
    assert m.quarantine.by_reason == {"low_confidence": 1, "parse_error": 1} and m.quarantine.by_type == {"unknown": 1, "web_access": 1}
    docs = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/normalized").collect()]
    assert {d["event"]["dataset"] for d in docs} == {"apache.access", "system.syslog"}
    assert {d["pipeline"]["ingest"]["seq"] for d in docs} == {1, 3}
    bad = {r.error.type: r.error.message for r in result.quarantine.collect()}
    assert set(bad) == {"low_confidence", "parse_error"}
    assert bad["low_confidence"].endswith("below threshold 0.8")
    assert bad["parse_error"] == "ValueError:apache combined mismatch"
    assert {r.log_type for r in spark.read.parquet(f"{tmp_path}/out/events").collect()} == {"web_access", "syslog"}
    assert any(f.startswith("part=web_access") for f in os.listdir(f"{tmp_path}/out/routed"))


def test_stream_equals_batch(spark, tmp_path, model):
    source = tmp_path / "in"
    source.mkdir()
    for f in range(3):
        (source / f"{f}.log").write_text("\n".join([WEB.format(i=f), "", SYSLOG.format(i=f), "zzz"]))
    run_batch(spark, [str(source)], f"{tmp_path}/batch", model)
    q = stream_normalize(spark, str(source), f"{tmp_path}/stream", f"{tmp_path}/state", model,
                         trigger={"availableNow": True}, max_files=1)
    q.awaitTermination()

    def ids(path):
        return Counter((r.value.split('"id":"')[1][:64]) for r in spark.read.text(path).collect())
    for kind in ("normalized", "quarantine"):
        assert ids(f"{tmp_path}/stream/{kind}") == ids(f"{tmp_path}/batch/{kind}")
    assert len(os.listdir(f"{tmp_path}/stream/normalized")) == 3


def test_cut_of_large_groups(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 < 2 THEN 'a' WHEN id % 30 = 2 THEN 'b' ELSE 'c' END AS g",
                                      "id", "sha2(cast(id AS STRING), 256) AS h")
    rows = df.collect()
    got = split_at(df, "g", "h", "least(total, 150)").collect()
    assert len(got) == 3000
    for g in "abc":
        ordered = sorted(r.h for r in rows if r.g == g)
        assert {r.h for r in got if r.g == g and r.first} == set(ordered[:150])


def test_global_numbering(spark):
    df = spark.range(500).selectExpr("id % 7 AS a", "id AS b")
    got = number_all(df, ["a", "b"]).collect()
    expected = {(r.a, r.b): i + 1 for i, r in enumerate(sorted(df.collect()))}
    assert {(r.a, r.b): r["rank"] for r in got} == expected


def test_replayed_batch_counts_once(spark, tmp_path):
    """A batch played twice replaces its own files and its own record."""
    batch = spark.createDataFrame([(WEB.format(i=i), f"file:/in/{i % 2}.log", 0) for i in range(10)], "value string, _file string, _block bigint")
    out = str(tmp_path / "out")
    for n, rows in ((0, batch), (1, batch), (1, batch.limit(4))):
        normalize_batch(rows, n, out, log_type="web_access", year_hint=2024)
    totals = {r.counter: r.n for r in stream_totals(spark, out).collect()}
    assert totals == {"total": 14, "normalized": 14, "ok:web_access": 14}
    assert committed(spark, out, "normalized").count() == 14 and committed(spark, out, "quarantine").count() == 0


def test_broken_source_is_switched_off(spark):
    odd = SourceSpec(name="odd", fields={"message": "raw"}, error="CASE WHEN raw = 'x' THEN 'ValueError:x' END", samples=("x", "y"))
    wild = SourceSpec(name="wild", event_type=("nowhere",))
    usable, errors = pipeline.tested_sources(spark, {**SOURCES, "odd": odd, "wild": wild})
    assert {r.log_type for r in usable.collect()} == set(SOURCES)
    assert errors == {"odd": "self-test: ValueError:x", "wild": "not in the schema: event.type nowhere"}


def test_user_function_runs_once_a_line(spark):
    """One Python stage, whatever filter stands on its outcome."""
    spec = custom_source(lambda raw: {"source.ip": raw}, name="mine")
    df = spark.createDataFrame([("1.2.3.4", "f", 1, "i", "h", "2024-01-01T00:00:00.000+00:00")], "raw string, source string, seq bigint, event_id string, event_hash string, received_at string")
    plan = normalize(df, spec, 2024)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_scoring_shuffles_nothing(spark, model):
    lines = spark.createDataFrame([(WEB.format(i=1),), (WEB.format(i=1),), ("zzz",)], "raw string")
    scored = classify(lines, model)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    rows = scored.collect()
    assert len(rows) == 3 and rows[0] == rows[1]


def slow_grams(line):
    out = Counter()
    for word in line.lower().split():
        padded = f" {word} "
        for n in range(2, 6):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def test_gram_counts_and_scores(spark, model):
    lines = ["Ab c", "", None, "a a a xyz\tq", "   ", "é🙂x ab", "x" * 400, "ab c " * 60]
    stats = {r.term: (r.cf, r.df) for r in term_statistics(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    each = [slow_grams(x or "") for x in lines]
    assert stats == {t: (sum(g[t] for g in each), sum(t in g for g in each)) for g in each for t in g}
    known = gramwise.Vocabulary(["ab", " ab ", "c ", "é🙂", "nowhere"], [1.0, 2.0, 0.5, 3.0, 1.0])
    weights, intercepts = np.array([[1.0, -1.0, 2.0, 0.5, 9.0], [0.0, 3.0, -2.0, 1.0, 9.0]]), np.array([0.25, -0.5])
    got = gramwise.probabilities(lines, known, weights, intercepts)
    for grams, p in zip(each, got):
        x = np.array([(1 + math.log(grams[t])) * i if grams[t] else 0.0 for t, i in zip(known.terms, known.idf)])
        m = weights @ (x / (np.linalg.norm(x) or 1)) + intercepts
        assert np.abs(np.exp(m - m.max()) / np.exp(m - m.max()).sum() - p).max() < 1e-12


def test_cut_of_the_vocabulary(spark):
    df = spark.range(2000).selectExpr("concat('t', lpad(id, 4, '0')) AS term", "id % 40 * 1000 + id % 3 AS cf").cache()
    ordered = sorted(((-r.cf, r.term) for r in df.collect()))
    for n in (0, 1, 49, 50, 51, 700, 1999, 2000, 5000):
        assert {(-r.cf, r.term) for r in largest(df, "cf", "term", n, cells=7).collect()} == set(ordered[:n])
    lines = spark.createDataFrame([("ab ab",), ("ab",), ("cd",)], "line string")
    assert {r.term for r in tfidf_terms(lines, min_df=2).collect()} == {" a", "ab", "b ", " ab", "ab ", " ab "}


def test_sizes_of_written_files(spark, tmp_path):
    """Small values have one file each, a large one as many as its size asks for."""
    df = spark.range(3000).selectExpr("CASE WHEN id < 2900 THEN 'big' WHEN id < 2950 THEN 'small' END AS k", "id")
    sized(df, ["k"], "id", 500).write.partitionBy("k").parquet(str(tmp_path / "t"))
    files = {d: len([f for f in os.listdir(tmp_path / "t" / d) if f.endswith(".parquet")]) for d in os.listdir(tmp_path / "t") if d.startswith("k=")}
    assert files == {"k=big": 6, "k=small": 1, "k=__HIVE_DEFAULT_PARTITION__": 1}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3000


def test_custom_python_source(spark):
    def parse(raw):
        return {"source.ip": raw, "n": len(raw), "dns.resolved_ip": ["10.0.0.1", "x"]} if raw != "boom" else 1 / 0
    out = extract(spark.createDataFrame([("1.2.3.4",), ("boom",)], "raw string"), custom_source(parse, name="mine")).collect()
    good = next(r for r in out if r.raw == "1.2.3.4")
    assert good.fields["source.ip"] == "1.2.3.4" and good.unmapped == {"n": "7"} and good.parse_error is None
    assert next(r for r in out if r.raw == "boom").parse_error == "ZeroDivisionError:division by zero"


def test_flatten(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":1},"d":[{"e":2}]},"a.d":3,"f":{},"g":0.000956}',), ("nope",)], "raw string")
    rows = {r.raw[:1]: r.flat for r in flatten_json(df).collect()}
    assert rows["n"] is None
    assert set(rows["{"]) == {"a.b.c", "a.d", "g"} and rows["{"]["g"] == "0.000956"


def test_flatten_has_no_deepest_level(spark):
    """Any number of levels is unfolded; braces in texts and lists open none; of two equal keys the last in key order counts."""
    deep = lambda n: '{"k":' * n + "1" + "}" * n
    cases = {deep(n): {".".join("k" * n): "1"} for n in (1, 2, 8, 9, 40, 200)}
    cases |= {'{"t":"{{{","l":[{"x":{"y":1}}]}': {"t": '"{{{"', "l": '[{"x":{"y":1}}]'}, '{"a.b":1,"a":{"b":2}}': {"a.b": "1"}, '{"a":{"b":{}}}': {}}
    got = flatten_json(spark.createDataFrame([(c,) for c in cases], "raw string")).collect()
    assert {r.raw: r.flat for r in got} == cases


def test_review_counts_all_lines_of_a_hot_template(spark):
    q = spark.range(1000).selectExpr("'low_confidence' AS kind", "'d' AS detail", "concat('line ', id) AS raw",
                                     "'u' AS log_type", "'f' AS source", "id AS seq")
    top = review.cluster_rank(q).collect()
    assert [(r.template, r.n) for r in top] == [("line <N>", 1000)]
    assert [r.sample for r in review.cluster_samples(q).orderBy("rank").collect()] == ["line 0", "line 1"]


def test_outputs_are_packed(spark, tmp_path, model):
    """F1-F3: the JSON lines of a run take less than a third of their length on disk, and no line is lost."""
    lines = [WEB.format(i=i) for i in range(4000)] + ["zzz qqq"] * 1000
    (tmp_path / "mixed.log").write_text("\n".join(lines) + "\n")
    run_batch(spark, [str(tmp_path / "mixed.log")], f"{tmp_path}/out", model, threshold=0.8)
    written = [r.value for kind in ("normalized", "quarantine") for r in spark.read.text(f"{tmp_path}/out/{kind}").collect()]
    assert Counter(json.loads(d)["event"]["original"] for d in written) == Counter(lines)

    def room(path):
        return sum(f.stat().st_size for f in path.glob("part-*"))
    assert 3 * (room(tmp_path / "out" / "normalized") + room(tmp_path / "out" / "quarantine")) < sum(map(len, written))


def test_ngrams_are_counted_where_their_lines_are(spark, sf_dir, monkeypatch):
    """lines are dealt by key before they become n-grams, over as many tasks as their number asks for."""
    from logweir.plans import model_queries
    monkeypatch.setattr(model_queries, "LINES_PER_TASK", 50, raising=False)
    grams = model_queries._ngrams(spark, sf_dir)
    plan = grams._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and plan.count("Exchange") == 1
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert grams.rdd.getNumPartitions() == lines // 50 + 1


def test_stream_outputs_are_packed(spark, tmp_path):
    """a stream's outputs are packed too, and its ledger names the packed files."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(WEB.format(i=i) for i in range(50)))
    stream_normalize(spark, str(tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/state", log_type="web_access",
                     trigger={"availableNow": True}).awaitTermination()
    files = spark.read.json(f"{tmp_path}/out/ledger/*").first().normalized
    assert files and all(f.endswith(".gz") for f in files)
    assert spark.read.text(files).count() == 50


def test_large_values_are_dealt(spark):
    """a task that writes a value of the keys takes no more than a quarter of a million rows by default."""
    from logweir.sources.sinks import sized
    rows = spark.range(600_000).selectExpr("'a' AS k", "id")
    assert sized(rows, ["k"], "id").rdd.getNumPartitions() == 3
