"""The id store's encoder keeps the words of one partition for the next."""

import random

import numpy as np

from logweir.llm import bpe, id_store
from logweir.llm.queries import tokenizer_path


def test_words_are_encoded_once():
    rng, tokenizer_file = random.Random(7), tokenizer_path("byte_bpe_50k.json")
    words = ["".join(rng.choices("abcdefgh é", k=7)) for _ in range(20_000)]
    texts = ["", None, " ", "x"] + [" ".join(rng.choices(words, k=2000)) for _ in range(60)]
    coder = bpe.ChunkCodec(tokenizer_file, id_store.REMEMBERED_IDS, id_store.BATCH)
    asked, library = [], coder.library_ids
    coder.library_ids = lambda parts: asked.append(len(parts)) or library(parts)
    counts = []
    for part in (texts[:34], texts[34:]):
        found = [ids.tolist() for ids, _ in coder.encode(part)]
        assert found == [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]
        counts.append(sum(asked))
        asked.clear()
        coder.forget(words=False)
        assert not len(coder.chunks.keys) and len(coder.words.keys)
    assert counts[1] < counts[0] / 2
    coder.forget()
    assert not len(coder.words.keys)


def test_parts_come_back_in_their_order():
    coder = bpe.ChunkCodec(tokenizer_path("byte_bpe_50k.json"))
    parts = [b" one", b"two", b" three ", b" four", b"\n", b" five\xc2\xa0", b" six"]
    for some in (parts, parts[1:3], parts[:1]):
        ids, size = coder.library_ids(some)
        alone = [coder.tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in some]
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == alone
