"""Keyed access reads as many bytes in a large shard as in a small one, and finds the shard by bisection."""

import numpy as np

from logweir.llm import id_store


class Counting:
    def __init__(self, file):
        self.file, self.bytes = file, 0

    def read_at(self, n, at):
        self.bytes += n
        return self.file.read_at(n, at)

    def close(self):
        self.file.close()


def shard(folder, n):
    rng = np.random.default_rng(n)
    ids = [rng.integers(0, 50_000, 7).astype("<u2") for _ in range(n)]
    keys = [3 * (i - i % 5 // 4) for i in range(n)]  # every fifth key stands twice
    return keys, ids, id_store.write_shard(str(folder), keys, ids, 2)


def test_bytes_read_do_not_grow(tmp_path):
    most = {}
    for n in (50, 5_000, 100_000):
        keys, ids, entry = shard(tmp_path, n)
        store = id_store.Shard(str(tmp_path), entry["name"])
        store.file = Counting(store.file)
        for i in (0, n // 3, n // 2, n - 1):
            store.file.bytes = 0
            found = store.get(keys[i])
            assert [f.tolist() for f in found] == [x.tolist() for k, x in zip(keys, ids) if k == keys[i]]
            most[n] = max(most.get(n, 0), store.file.bytes)
        assert store.get(1) == [] and store.get(-5) == []
        assert {k: tuple(int(x[0]) for x in store.rows(np.array([k]))) for k in keys[:40]} == {k: store.look(k) for k in keys[:40]}
        store.close()
    assert max(most.values()) < 600


def test_shards_are_bisected():
    manifest = [{"low": None, "high": None, "name": "x"}] + [{"low": 10 * k, "high": 10 * k + 9 if k != 4 else 50, "name": str(k)} for k in range(100)]
    store = id_store.IdStore("/nowhere", manifest)
    for key in (-1, 0, 9, 39, 40, 50, 51, 999, 1000):
        assert store.shards_of(key) == [m for m in manifest if m["low"] is not None and m["low"] <= key <= m["high"]]
