"""op5 stores the map edited for one more shard as version 2 and says where each record goes."""

from collections import Counter

from logweir.llm import queries, shards


def test_grown_shard_follows_the_edited_map(spark, sf_dir):
    rows = queries.QUERIES["op5_sharding"](spark, sf_dir).collect()
    sizes, old, new = Counter(), {}, {}
    for r in rows:
        sizes[r.virtual_slot] += r.size
        assert old.setdefault(r.virtual_slot, r.shard) == r.shard and new.setdefault(r.virtual_slot, r.rebalanced_shard) == r.rebalanced_shard
        # The law is `bytes`: only law `key` gives a grown shard.
        assert r.law == "bytes" and r.grown_shard is None
    held = {s: (n, 1) for s, n in sizes.items()}
    first = shards.new_map(held, 40)
    second = shards.rebalance(first, held, 41)
    assert {s: (first[s], second[s]) for s in sizes} == {s: (old[s], new[s]) for s in sizes}
    assert 40 in new.values() and set(new.values()) <= set(range(41))


def test_both_versions_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(400)], "doc_id long, text string")
    got = shards.assign(df, 4, slots=64, map_path=str(tmp_path / "map"), grown=5)
    one, two = ({r.virtual_slot: r.shard for r in shards.stored_map(spark, str(tmp_path / "map"), v).collect()} for v in (1, 2))
    assert set(one.values()) == set(range(4)) and set(two.values()) == set(range(5)) and len(one) == len(two) == 64
    assert all(one[s] == two[s] or two[s] == 4 for s in one)
    assert all((r.shard, r.grown_shard) == (one[r.virtual_slot], two[r.virtual_slot]) for r in got.collect())
    assert "grown_shard" not in shards.assign(df, 4, slots=64).columns
