"""A worker of the encoder holds little at a time, whatever its texts are."""

import random

from logweir.llm import bpe
from logweir.llm.queries import tokenizer_path


def test_batches_and_tables_stay_small():
    rng, codec = random.Random(5), bpe.ChunkCodec(tokenizer_path("byte_bpe_50k.json"))
    texts = [" ".join("".join(rng.choices("abcdefgh é", k=7)) for _ in range(2000)) for _ in range(100)]
    sizes, whole = [], codec.encode_batch
    codec.encode_batch = lambda raw: sizes.append(sum(map(len, raw))) or whole(raw)
    found = []
    for ids, _ in codec.encode(texts):
        found.append(ids.tolist())
        assert sum(len(t.pool) for t in (codec.words, codec.chunks)) <= 1_000_000
    assert len(sizes) > 1 and max(sizes) <= 1 << 18
    assert found == [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
