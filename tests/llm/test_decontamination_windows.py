"""Windows of the decontamination: texts without spaces, edits wherever they stand, repetitive texts."""

import random

import numpy as np
import pytest

from logweir.llm import decontaminate
from test_pairs_and_repeats import edited

LETTERS = "abcdefghijklmnopqrstuvwxyz"
CHINESE = [chr(c) for c in range(0x4E00, 0x4F00)]


def noise(rng, n, letters=LETTERS):
    return "".join(rng.choice(letters) for _ in range(n))


def prose(rng, n):
    return " ".join(noise(rng, rng.randint(2, 8)) for _ in range(n))[:n].strip()


@pytest.mark.parametrize("letters", [LETTERS, CHINESE])
def test_copies_in_unspaced_text(letters):
    rng = random.Random(1)
    items = [noise(rng, n, letters) for n in (12, 30, 81, 120, 250, 394)]
    index = decontaminate.ItemIndex(list(range(len(items))), items)
    texts = [noise(rng, 700, letters) + q + noise(rng, 600, letters) for q in items]
    assert [[x[0] for x in row if x[1] == 0] for row in index.find(texts)] == [[i] for i in range(len(items))]
    assert [row[0][2] for row in index.find(texts)] == [700 + len(q) for q in items]


def substituted(text, places):
    out = list(text)
    for p in places:
        out[p] = "#"
    return "".join(out)


@pytest.mark.parametrize("m, edits", [(120, 6), (120, 9), (120, 12), (200, 20), (394, 19), (394, 31), (394, 39)])
def test_spread_and_front_loaded_edits(m, edits):
    rng = random.Random(m + edits)
    items = [noise(rng, n) for n in (315, m, m, 90)]
    index = decontaminate.ItemIndex(list(range(4)), items)
    for places in (np.linspace(0, m - 1, edits).astype(int), np.arange(edits) * min(12, m // edits), m - 1 - np.arange(edits) * min(12, m // edits)):
        got = index.find([noise(rng, 500) + " " + substituted(items[1], places) + " " + noise(rng, 500)])
        assert [(i, d) for i, d, _ in got[0]] == [(1, edits)]


def test_no_stretch_within_the_limit_is_lost(monkeypatch):
    monkeypatch.setattr(decontaminate, "_ENTRIES", 50)
    rng = random.Random(3)
    items = [decontaminate.normalize(prose(rng, n)) for n in [*range(5, 60, 3), *range(60, 400, 11)]]
    index, found = decontaminate.ItemIndex(list(range(len(items))), items), 0
    for i, q in enumerate(items):
        text = decontaminate.normalize(prose(rng, 300) + " " + edited(rng, q, int(0.1 * len(q))) + " " + prose(rng, 300))
        want = {(j, decontaminate.best_stretch(p, text)[0]) for j, p in enumerate(items)}
        assert {(j, d) for j, d, _ in index.find([text])[0]} == {(j, d) for j, d in want if d <= int(0.1 * len(items[j]))}
        found += 1
    assert found == len(items)


def test_repetitive_texts(monkeypatch):
    monkeypatch.setattr(decontaminate, "_ENTRIES", 1000)
    index = decontaminate.ItemIndex([1, 2, 3], ["x" * 100, "ab" * 60, "a"])
    got = index.find(["y" * 50 + "x" * 2000, "ab" * 900, "x" * 89, None, "", "z a"])
    assert [[x[:2] for x in row] for row in got] == [[(1, 0)], [(2, 0), (3, 0)], [], [], [], [(3, 0)]]


def test_items_without_id_count(spark):
    q = "a passage of the benchmark that nobody has given a number but that must not stay in the corpus"
    items = spark.createDataFrame([(None, q), (None, "some other passage without a number, also to be found"), (1, "a numbered passage of another kind")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"x {q} y"), (2, "clean"), (3, "this is a numbered passage of another kind")], "doc_id long, text string")
    got = decontaminate.contamination(df, items).select("doc_id", "item_id", "distance").collect()
    assert sorted(map(tuple, got)) == [(1, None, 0), (3, 1, 0)]
    assert [r.doc_id for r in decontaminate.decontaminated(df, items).collect()] == [2]


def test_lsh_alone_reaches_its_recall(monkeypatch):
    """Candidates come from shared keys only: recall by distance, edits spread evenly, and none at all without keys."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(2000)]
    items = [" ".join(rng.choice(words, n)) for n in rng.integers(6, 60, 150)]
    index = decontaminate.ItemIndex(list(range(len(items))), items)
    for ratio, least in ((0, 1.0), (0.05, 0.98), (0.08, 0.95), (0.1, 0.9)):
        docs = []
        for t in items:
            k, letters = int(ratio * len(t)), list(t)
            for p in np.linspace(0, len(t) - 1, k).astype(int)[::-1].tolist():
                kind = rng.integers(3)
                letters[p : p + (kind != 1)] = [] if kind == 2 else [chr(97 + rng.integers(26))]
            docs.append(" ".join([*rng.choice(words, 20), "".join(letters), *rng.choice(words, 20)]))
        found = index.find(docs)
        assert np.mean([any(i == k for i, _, _ in row) for k, row in enumerate(found)]) >= least
    for c in index.classes:
        c.keys = [(key[:0], those[:0]) for key, those in c.keys]
    assert index.find(items) == [[] for _ in items]
