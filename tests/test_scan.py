"""Scans of repeated files, odd names and odd documents."""

from logweir.operators.robustness import perturbed_scores
from logweir.operators.classify import LogTypeModel
from logweir.sources.scan import read_corpus, read_lines


def test_a_file_beside_its_folder_is_numbered_twice(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n\ny\n")
    (tmp_path / "b.log").write_text("z\n")
    rows = read_lines(spark, [str(tmp_path), str(tmp_path / "a.log"), str(tmp_path / "a.log")]).collect()
    assert sorted((r.source[-5:], r.seq, r.raw) for r in rows) == sorted([("a.log", 1, "x"), ("a.log", 3, "y")] * 3 + [("b.log", 1, "z")])


def test_names_are_no_patterns(spark, tmp_path):
    odd = tmp_path / "a[1] {b}.log"
    odd.write_text("x\n")
    (tmp_path / "a1.log").write_text("other\n")
    assert [(r.source, r.seq, r.raw) for r in read_lines(spark, str(odd)).collect()] == [(str(odd), 1, "x")]


def test_corpus_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"note":"[draft]",\n"rows":[{"v":0.000956}],"also":[1]}')
    (tmp_path / "two.json").write_text('[{"a":\n1},{"a":2}]')
    (tmp_path / "none[1].json").write_text('{"a":\n1}')
    (tmp_path / "bad.json").write_text('[{"a":')
    rows = {(r.label, r.line) for r in read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {("one", '{"v":0.000956}'), ("two", '{"a":1}'), ("two", '{"a":2}'), ("bad", '[{"a":'), ("none[1]", '{"a":\n1}')}


def test_labels_with_colons(spark):
    terms = spark.createDataFrame([("abc", 1.0, [1.0, -1.0])], "term string, idf double, weights array<double>")
    model = LogTypeModel(("asa:v1", "b"), (0.0, 0.0), terms, 1)
    out = perturbed_scores(spark.createDataFrame([("asa:v1", "abc")], "label string, line string"), model)
    assert [r.label for r in out.collect()] == ["asa:v1"]
