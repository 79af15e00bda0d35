"""Token counts of long texts without spaces: equal to the library, and not quadratic."""

import base64
import time

import numpy as np
import pytest

from logweir.llm import queries, token_count


@pytest.fixture(scope="module")
def counter():
    return token_count.counter(queries.tokenizer_path("piece_bpe_32k.model"))


def unspaced(kind, n, rng):
    return {"letters": lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)), "words": lambda: "".join(rng.choice(["the", "ing", "ation", "er", "Über", "s", "0x", "qu"], n // 3)),
            "one": lambda: "a" * n, "two": lambda: "ab" * (n // 2), "equals": lambda: "=" * n, "base64": lambda: base64.b64encode(rng.bytes(n * 3 // 4)).decode(),
            "ideographs": lambda: "".join(chr(c) for c in rng.integers(0x4E00, 0x5000, n)), "digits": lambda: "".join(rng.choice(list("0123456789"), n)),
            "outside": lambda: "".join(rng.choice(list("a\U00010348ሴé"), n))}[kind]()


KINDS = ["letters", "words", "one", "two", "equals", "base64", "ideographs", "digits", "outside"]


@pytest.mark.parametrize("kind", KINDS)
def test_counts_equal_the_library(counter, kind):
    rng = np.random.default_rng(len(kind))
    texts = [unspaced(kind, n, rng) for n in (511, 512, 513, 514, 700, 3001, 9000)]
    texts += [f"some words {t} and more" for t in texts[-2:]]
    assert counter.count_texts(texts).tolist() == [len(counter.library.encode(t)) for t in texts]


@pytest.mark.parametrize("kind", ["letters", "one", "base64", "ideographs"])
def test_a_megabyte_takes_seconds(counter, kind):
    text = unspaced(kind, 1_000_000, np.random.default_rng(1))
    start = time.time()
    found = counter.count_texts([text])[0]
    assert time.time() - start < 60
    assert found == len(counter.library.encode(text))


def test_work_list_equals_rounds(counter):
    rng = np.random.default_rng(9)
    for _ in range(60):
        symbols = rng.integers(0, counter.pieces, 40)
        rounds = counter.merge(symbols.copy(), np.zeros(len(symbols), np.int64))[0]
        assert counter.merge_long(symbols).tolist() == rounds.tolist()
