"""Texts on which prefix sums modulo 2**64 collide by construction: no wrong ids, no false links."""

import hashlib

import numpy as np
import pytest

from logweir.llm import bpe, hashing, ngram_join, queries


def doubled(a: str, b: str, units: int) -> tuple[str, str]:
    """The Thue-Morse word of ``units`` letters and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(units)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


PAIRS = [p for a, b in (("a", "b"), ("q", "z"), ("ab", "cd"), ("é", "ß")) for n in (512, 1024, 2048, 4096, 8192) for p in doubled(a, b, n)]


def test_linear_hash_does_collide():
    one, two = (np.frombuffer(t.encode(), np.uint8) for t in doubled("a", "b", 1024))
    sums = [hashing.range_hash(hashing.prefix_sums(hashing.BYTE_VALUES[x]), np.array([0]), np.array([1024]))[0] for x in (one, two)]
    assert sums[0] == sums[1]
    trees = [hashing.tree_hash(hashing.BYTE_VALUES[x], np.array([0]), np.array([1024]))[0] for x in (one, two)]
    assert trees[0] != trees[1]


def test_tree_hash_depends_on_content_and_length_alone():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 3, 3000).astype(np.uint64)
    first = rng.integers(0, 2900, 4000)
    last = first + rng.integers(0, 40, 4000)
    found = {}
    for a, b, h in zip(first.tolist(), last.tolist(), hashing.tree_hash(symbols, first, last).tolist()):
        assert found.setdefault(h, symbols[a:b].tobytes()) == symbols[a:b].tobytes()
    assert len(found) == len({symbols[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())})


@pytest.mark.parametrize("frame", ["{}", "one {} two three {}", "{}\n"])
def test_ids_of_doubled_texts(spark, frame):
    library = bpe.codec(queries.tokenizer_path("byte_bpe_50k.json")).tokenizer
    rows = [(i, frame.format(*[t] * frame.count("{}"))) for i, t in enumerate(PAIRS)]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.tokenizer_path("byte_bpe_50k.json"), with_ids=True)
    for r in got.collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_wrong_entry_is_mended():
    """Ids under a key that another text shares are never given out."""
    coder = bpe.ChunkCodec(queries.tokenizer_path("byte_bpe_50k.json"))
    text = "some words of one text " * 40
    right = [ids.tolist() for ids, _ in coder.encode([text])]
    coder.chunks.pool = coder.chunks.pool[::-1].copy()
    coder.words.pool = coder.words.pool[::-1].copy()
    assert [ids.tolist() for ids, _ in coder.encode([text])] == right == [coder.tokenizer.encode(text, add_special_tokens=False).ids]


def test_long_words_make_no_links(spark):
    rows = [(i, f"{t} one two three four") for i, t in enumerate(PAIRS)]
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows}
