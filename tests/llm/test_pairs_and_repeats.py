"""Decontamination, n-gram join, suffix-array dedup and the pipeline against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from logweir.llm import decontaminate, ngram_join, queries, suffix_dedup, toxicity
from logweir.llm.components import components

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def family(seed, n=40):
    """Near copies around the limit, copies, shared passages, and odd rows; ids repeat and are missing."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 4)))
    base, passage = [word() for _ in range(60)], " ".join(word() for _ in range(30))
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(n + i, f"{' '.join(word() for _ in range(rng.randint(0, 40)))} {passage} {word()}") for i in range(15)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "One  two"), (205, "one two three"), (206, "x" * 9000), (207, "the " * 3000),
             (208, rows[3][1]), (209, rows[3][1].upper()), (3, rows[5][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (None, passage * 2)]
    rng.shuffle(rows)
    return rows


def shingles(text, width=5):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))) if w else frozenset()


def brute_components(rows):
    """(id, set size, component) of every row, and the rows by component."""
    sets, owners = [shingles(t) for _, t in rows], defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, s in enumerate(sets):
        shared = Counter(y for g in s for y in owners[g])
        for g in s:
            owners[g].append(x)
        for y, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[y]) - k):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return Counter((i, len(s), least.get(find(x)) if s else i) for x, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_on_families(spark, seed, monkeypatch):
    if seed == 2:  # a block in many parts
        monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
    rows = family(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, chunk int")
    got = ngram_join.link_documents(df).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)
    kept = ngram_join.keep_one_each(df)
    assert kept.columns == df.columns
    want = [c for (i, n, c) in brute_components(rows).elements() if n and c is not None]
    assert len({r.doc_id for r in kept.collect()} & set(want)) == len(set(want))
    assert ngram_join.link_documents(df.limit(0)).count() == 0 and ngram_join.keep_one_each(df.limit(0)).count() == 0


def test_join_on_documents(spark, sf_dir, docs):
    got = queries.QUERIES["op8_ngram_join"](spark, sf_dir).collect()
    assert Counter(tuple(r) for r in got) == brute_components(docs)


def test_search_against_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(40)]
        sets.sort(key=len)
        s = ngram_join.Search([len(x) for x in sets], sets)
        s.run()
        root = list(range(40))
        find = lambda x: x if root[x] == x else find(root[x])
        for x in range(40):
            for y in range(x):
                k = len(np.intersect1d(sets[x], sets[y]))
                if 100 * k >= 80 * (len(sets[x]) + len(sets[y]) - k):
                    root[find(x)] = find(y)
        assert len({s.find(x) for x in range(40)}) == len({find(x) for x in range(40)})
        assert all((s.find(x) == s.find(y)) == (find(x) == find(y)) for x in range(40) for y in range(x))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, n=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1) if i is not None else ():
            least[b[p : p + n]] = min(least.get(b[p : p + n], i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1) if i is not None else ():
            if least[b[p : p + n]] < i:
                gone[p : p + n] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_in_families(spark, seed, monkeypatch):
    if seed == 2:  # every anchor counts as very common, and blocks are small
        monkeypatch.setattr(suffix_dedup, "HOT", 1)
        monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rows = family(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept_sha256 string, bucket int")
    got = suffix_dedup.remove_repeats(df)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_repeats(rows)
    kept = suffix_dedup.remove_repeats(df, replace_text=True)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_in_documents(spark, sf_dir, docs):
    got = queries.QUERIES["op9_suffix_dedup"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(docs)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(30), 100, 500]:
        for k in (1, 2, 5):
            s = rng.integers(1, k + 1, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def distance(a, b):
    """Smallest edit distance between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([["q"], [out[i], "z"], []])
    return "".join(out)


def test_best_stretch():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("ab ", k=rng.randint(1, n))) for n in (12, 40))
        assert decontaminate.best_stretch(a, b)[0] == distance(a, b)


def test_decontamination_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 600 and 1500").orderBy("doc_id").limit(700).collect()]
    index, rng = decontaminate.ItemIndex(*zip(*items)), random.Random(5)
    clean = [t for t, f in zip(clean, index.find(clean)) if not f][: len(items)]
    for ratio, least in ((0.0, 1.0), (0.04, 1.0), (0.1, 0.9)):
        planted = [edited(rng, decontaminate.normalize(q), int(ratio * len(decontaminate.normalize(q)))) for _, q in items]
        texts = [f"{c[:300]} {p.upper() if k % 2 else p} {c[300:]}" for k, (c, p) in enumerate(zip(clean, planted))]
        found = index.find(texts)
        recall = np.mean([any(f[0] == i for f in row) for (i, _), row in zip(items, found)])
        assert recall >= least, (ratio, recall)
        for text, row in zip(texts[:20], found):
            for i, d, _ in row:
                q = decontaminate.normalize(dict(items)[i])
                assert d == distance(q, decontaminate.normalize(text)) and d <= 0.1 * len(q)


def test_decontamination_query(spark, sf_dir, docs):
    items = {r.item_id: decontaminate.normalize(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs for i, q in items.items() if q in decontaminate.normalize(t)}
    got = queries.QUERIES["op3_decontamination"](spark, sf_dir).collect()
    assert exact == {(r.doc_id, r.item_id) for r in got if r.distance == 0}
    texts = dict(docs)
    assert all(r.distance == distance(items[r.item_id], decontaminate.normalize(texts[r.doc_id])) for r in got if r.distance)


def test_decontamination_edges(spark):
    q = "a passage of the benchmark that is long enough to be told from chance by its grams"
    items = spark.createDataFrame([(1, q), (1, q), (2, None), (3, ""), (None, "lost"), (4, "tiny")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"x {q.upper()} y", 5), (1, f"x {q.upper()} y", 5), (2, None, 5), (3, "", 5), (None, q, 5), (5, "clean " * 2000, 5), (6, "a tiny one", 5)],
                               "doc_id long, text string, item_id int")
    got = decontaminate.contamination(df, items).select("doc_id", "item_id", "distance").collect()
    assert Counter(map(tuple, got)) == Counter([(1, 1, 0)] * 2 + [(None, 1, 0), (6, 4, 0)])
    left = decontaminate.decontaminated(df, items)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert decontaminate.contamination(df, items.limit(0)).count() == 0 and decontaminate.contamination(df.limit(0), items).count() == 0


def test_pipeline(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in documents.collect()}
    ids = list(rows)
    scores = queries.toxicity_model(spark, sf_dir).scores([rows[i] for i in ids])
    rows = {i: rows[i] for i, s in zip(ids, scores) if s < 0.5}
    rows = {i: t for i, t in rows.items() if (i, len(shingles(t)), i) in brute_components(rows.items())} if len(rows) < 50 else {
        i: rows[i] for i, _, c in brute_components(list(rows.items())) if i == c}
    left = {e[0]: e for e in brute_repeats(list(rows.items()))}
    cut = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(documents.where(documents.doc_id.isin(list(rows))), replace_text=True).collect()}
    assert all(hashlib.sha256(cut[i].encode()).hexdigest() == left[i][4] or "�" not in cut[i] for i in rows)
    items = decontaminate.ItemIndex(*zip(*[(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]))
    dirty = {i for i, f in zip(cut, items.find(list(cut.values()))) if f}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in cut.items() if i not in dirty}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    df = spark.createDataFrame([(i, t, None, "s", 3, "p") for i, t in family(3)], "doc_id long, text string, lang string, source string, n_chars long, predicted string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns and out.count() > 0
        assert stage(spark, df.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.encode(spark, df, sf_dir).count() == df.count()
