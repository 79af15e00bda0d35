"""Quartile digests, fill-in-the-middle and whitening against plain Python and numpy."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logweir.llm import digest, fim, queries, whitening

TEXTS = [None, "", "a", "ab", "abc", "é🙂" * 9, "one two three four " * 400, "x" * 700_000, "<P>in it", "two lines\n" * 30, "two lines\n" * 30, "日本語の文章です。" * 50]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 7, "kept") for i, t in enumerate(TEXTS)] + [(4, "again under one id", 8, "k"), (4, "again under one id", 8, "k"), (None, "no id", 9, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, fingerprint string")


# --- digests ---------------------------------------------------------------------------


def slow_fingerprint(text):
    """The digest by its definition, triplet by triplet."""
    b, counts = (text or "").encode(), [0] * digest.BUCKETS
    for p in range(len(b)):
        for k, (i, j) in enumerate(digest.TRIPLETS):
            if p + j < len(b):
                x = (b[p] << 16 | b[p + i] << 8 | b[p + j]) + (k << 24)
                x = (x ^ x >> 15) * 0x2C1B3C6D % (1 << 32)
                x = (x ^ x >> 12) * 0x297A2D39 % (1 << 32)
                counts[(x ^ x >> 15) % digest.BUCKETS] += 1
    q = [sorted(counts)[k * digest.BUCKETS // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(c > x for x in q) for c in counts]
    return f"{min(int(math.log1p(len(b)) / math.log(1.1)), 255):02x}" + "".join(
        f"{codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3]:02x}" for i in range(0, len(codes), 4)), codes


def slow_likeness(one, two):
    (f, a), (g, b) = one, two
    cost = [0, 1, 2, digest.FAR]
    found = sum(cost[abs(x - y)] for x, y in zip(a, b))
    expected = sum(a.count(x) * b.count(y) * cost[abs(x - y)] for x in range(4) for y in range(4)) / digest.BUCKETS
    part = found / expected if expected else float(found > 0)
    steps = abs(int(f[:2], 16) - int(g[:2], 16))
    return 1 - min(1, part + min(max(steps - 1, 0) * digest.LENGTH_COST, digest.LENGTH_LIMIT))


def check_neighbours(rows, ordered):
    """``ordered``: (id, text) in the operator's order; equal rows may stand for each other."""
    short = {t for _, t in ordered if len(t) < 20_000}
    prints = {t: slow_fingerprint(t) for t in short}
    want = []
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 4
        want.append((i is not None, i or 0, hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest(), len(t)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.edited_sha256, r.n_chars) for r in rows) == sorted(want)
    text = {hashlib.sha256((t[: len(t) - len(t) // 4] + ordered[(k + 1) % len(ordered)][1][: len(t) // 4]).encode()).hexdigest(): (t, ordered[(k + 1) % len(ordered)][1])
            for k, (i, t) in enumerate(ordered) if len(t) >= 4}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.edited_sha256 in text:
            own, following = text[r.edited_sha256]
            if own in short and following in short and len(own) == r.n_chars:
                changed = slow_fingerprint(own[: len(own) - len(own) // 4] + following[: len(own) // 4])
                assert (r.fingerprint, r.edited_fingerprint) == (prints[own][0], changed[0])
                assert abs(r.near_edited - slow_likeness(prints[own], changed)) < 1e-9
                assert abs(r.near_next - slow_likeness(prints[own], prints[following])) < 1e-9


def test_digests_of_documents(spark, sf_dir):
    rows = queries.QUERIES["op11_fingerprints"](spark, sf_dir).collect()
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check_neighbours(rows, docs)
    long = [r for r in rows if r.n_chars >= 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    same = {}
    for r in rows:
        assert same.setdefault(dict(docs)[r.doc_id], r.fingerprint) == r.fingerprint


def test_digests_of_odd_rows(spark, odd):
    out = digest.with_neighbours(odd)
    assert out.columns == ["doc_id", "n", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = out.collect()
    assert len(rows) == odd.count()
    from pyspark.sql import functions as F

    keyed = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()
    ordered = [(r.doc_id, r.t) for r in sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    check_neighbours(rows, ordered)
    empties = [r for r in rows if r.n_chars == 0]
    assert len({r.fingerprint for r in empties}) == 1
    assert digest.with_neighbours(odd.limit(0)).count() == 0
    one = digest.with_neighbours(odd.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_neighbours_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "repeat(concat('text ', id % 7, ' '), cast(id % 40 AS int)) AS text")
    one = {r.doc_id: r for r in digest.with_neighbours(df.coalesce(1)).collect()}
    many = {r.doc_id: r for r in digest.with_neighbours(df.repartition(13)).collect()}
    assert one == many and len(one) == 500
    # All rows alike: the place in the scan deals them out.
    same = spark.range(300).selectExpr("1L AS doc_id", "'the same text in every row' AS text")
    assert {(r.near_edited == 1.0, r.near_next) for r in digest.with_neighbours(same).collect()} <= {(True, 1.0), (False, 1.0)}


# --- fill-in-the-middle ----------------------------------------------------------------


def slow_fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fim_of_documents_and_odd_rows(spark, sf_dir, odd):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_fill_in_middle"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, a, m, output = slow_fim(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
    got = fim.fill_in_middle(odd, with_texts=True)
    assert got.columns[:2] == ["doc_id", "text"] and got.count() == odd.count()
    for r in got.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow_fim(r.doc_id, r.text) and r.restored == (r.text or "")
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>aé🙂", max_size=40), st.integers(0, 5000), st.booleans())
def test_fim_restores_every_text(text, number, long_form):
    h = hashlib.sha256(str(number).encode()).hexdigest()
    n, form, a, m, table = fim.transform(text, h, 100, 100 if long_form else 0)
    assert n == len(text) and bytes(fim.restore(bytes(table), form)).decode() == text
    assert form == "plain" or (form == ("spm" if long_form else "psm") and a + m <= n)


def test_pieces_are_split_not_copied():
    buffer = b"0123456789"
    parts = fim.PieceTable.of(buffer).cut([0, 3, 3, 10])
    assert [bytes(p) for p in parts] == [b"", b"012", b"", b"3456789", b""]
    assert all(p[0] is buffer for part in parts for p in part.pieces)
    joined = parts[3] + parts[1]
    assert [bytes(p) for p in joined.cut([7, 8])] == [b"3456789", b"0", b"12"] and joined.sha256() == hashlib.sha256(b"3456789012").hexdigest()


# --- whitening -------------------------------------------------------------------------


def integers(vector):
    return [math.floor(1024 * float(c)) + 100000 for c in vector]


def slow_polynomial(matrix):
    """Faddeev and LeVerrier's recursion over fractions."""
    d = len(matrix)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][x] * m[x][j] for x in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-Fraction(sum(matrix[i][x] * m[x][i] for i in range(d) for x in range(d)), k))
    return [int(c) for c in out]


def check_whitened(rows, vectors):
    """``vectors``: id -> entries of the fit list (ids are distinct)."""
    x = {i: integers(v) for i, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[k] for v in x.values()) for k in range(d)]
    centred = np.array([[v[k] - sums[k] / n for k in range(d)] for v in x.values()])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = max(r.component for r in rows)
    by_row = {}
    for r in rows:
        by_row.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)) and r.deviation_text is None
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-6 and r.identity_error <= 1e-6
    assert set(by_row) == set(x) and all(set(c) == set(range(1, k + 1)) for c in by_row.values())
    got = np.array([[by_row[i][c].whitened for c in range(1, k + 1)] for i in x])
    assert np.abs(np.cov(got.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-6
    for c in range(k):
        gap = min(abs(values[c] - v) for j, v in enumerate(values) if j != c) / values[0] if d > 1 else 1
        if gap > 1e-6:
            want = centred @ axes[:, c] / np.sqrt(values[c])
            assert min(np.abs(got[:, c] - want).max(), np.abs(got[:, c] + want).max()) < 1e-5


def test_whitening_of_embeddings(spark, sf_dir):
    rows = queries.QUERIES["op13_whitening"](spark, sf_dir).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
               if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)}
    assert max(r.component for r in rows) == 8
    check_whitened(rows, vectors)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = {i: v for i, v in enumerate((rng.normal(size=(60, 3)) * [1, 2, 3]).tolist())}
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, n int, component string"
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in [*good.items(), *bad]], schema)
    rows = whitening.whiten(df, whitening.fit(df)).collect()
    check_whitened(rows, good)
    assert {r.component for r in rows} == {1, 2, 3}
    # No variance: no rows. Rank one, repeated and without ids: rows of one component.
    for some in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], bad[:5]):
        empty = spark.createDataFrame([(i, v, 1, "x") for i, v in some], schema)
        out = whitening.whiten(empty, whitening.fit(empty))
        assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]
    line = spark.createDataFrame([(None, [float(i), 2.0 * i], 1, "x") for i in (0, 1, 1, 2)], schema)
    rows = whitening.whiten(line, whitening.fit(line)).collect()
    assert len(rows) == 4 and {r.component for r in rows} == {1} and sorted(round(abs(r.whitened), 6) for r in rows) == [0, 0, 1.414214, 1.414214]


def test_whitening_of_huge_entries_is_exact(spark):
    vectors = [[1e12, 0.0], [-1e12, 5.0], [3.0, 2.0**60]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    x = [integers(v) for v in vectors]
    x[2][1] = (1 << 63) - 1
    model = whitening.fit(df)
    sums = [sum(v[k] for v in x) for k in range(2)]
    assert [s + model.n * whitening.SHIFT for s in model.sums] == sums
    want = [sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    for r in whitening.whiten(df, model).collect():
        assert r.deviation is None and int(r.deviation_text) == want[r.vec_id]


def test_polynomial_roots_and_null_space(spark):
    rng = np.random.default_rng(2)
    for d, n in ((1, 3), (2, 5), (4, 3), (6, 30)):
        y = rng.integers(-400, 400, (n, d))
        products = whitening.gram(y)
        assert products.tolist() == (y.astype(object).T @ y.astype(object)).tolist()
        sums = y.astype(object).sum(axis=0)
        matrix = products * n - np.outer(sums, sums)
        poly = whitening.characteristic_polynomial(spark, matrix)
        assert poly == slow_polynomial(matrix.tolist())
        roots = whitening.largest_roots(poly, 8)
        values = np.linalg.eigvalsh(matrix.astype(float))[::-1]
        assert sum(m for _, m in roots) == min(d, n - 1)
        for (root, _), value in zip(roots, values):
            assert abs(root / 2**96 / value - 1) < 1e-9
            v = whitening.null_space(matrix, root, 1)[0]
            assert np.abs(matrix.astype(float) @ v - value * v).max() < 1e-9 * values[0]
    # A double and a zero root.
    matrix = np.diag([9, 9, 4, 0]).astype(object)
    roots = whitening.largest_roots(whitening.characteristic_polynomial(spark, matrix), 8)
    assert roots == [(9 << 96, 2), (4 << 96, 1)]
    v = whitening.null_space(matrix, 9 << 96, 2)
    assert np.abs(v @ v.T - np.eye(2)).max() < 1e-12 and np.abs(v[:, 2:]).max() < 1e-12


def test_limbs_join_again():
    for v in (0, -1, 1 << 170, -(1 << 170) + 12345, (1 << 36) - 1):
        assert sum(x << 36 * k for k, x in enumerate(whitening.limbs([v])[0])) == v
