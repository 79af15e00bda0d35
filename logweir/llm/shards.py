"""Sharding by fixed virtual slots, with DataFrame functions only.

Every record hashes to one of some thousand slots. Bytes and rows are summed per
slot (partial sums before the shuffle), and a versioned map says which shard holds
a slot. Rebalancing edits the map: slots move, records keep their slot. The slot
table has ``slots`` rows whatever the input, so the driver plans on it.

Within its shard a record has a place, counted from 0 without gaps: its slot's first
place in the shard plus its rank in the slot. Only rows of one slot are ranked
together, and a slot holds 1/``slots`` of the records.

Defined results. The slot comes from id and text together, so rows that share an id
(null included) spread over the slots; rows equal in both share a slot. A null text
has 0 bytes and the checksum of the empty text. An empty table gives no rows and an
even map. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .columns import col, free_name, utf8_length

SLOTS = 8192
OVERHEAD = 16


def with_slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, overhead: int = OVERHEAD) -> DataFrame:
    """Adds size (UTF-8 bytes plus ``overhead``), text_crc32 and virtual_slot."""
    text = F.coalesce(col(df, text_col), F.lit(""))
    added = {"size": utf8_length(text) + overhead, "text_crc32": F.crc32(text.cast("binary")),
             "virtual_slot": F.pmod(F.xxhash64(col(df, id_col), text), F.lit(slots)).cast("int")}
    return df.select(*[col(df, c) for c in df.columns if c.lower() not in added], *[v.alias(k) for k, v in added.items()])


def slot_sizes(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows); at most as many entries as there are slots."""
    sums = slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return {r.virtual_slot: (r.bytes, r.n) for r in sums.collect()}


def new_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """Slot -> shard: the largest slots first, each to the shard with the fewest bytes so far."""
    load, out = [(0, s) for s in range(shards)], [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, (0, 0))[0], s)):
        held, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (held + sizes.get(slot, (0, 0))[0], shard))
    return out


def rebalance(old: list[int], sizes: dict[int, tuple[int, int]], shards: int, slack: float = 0.01) -> list[int]:
    """Edit a map for new sizes or another shard count, moving only slots that must move.

    Slots of shards that no longer exist move first; then shards above the mean by
    more than ``slack`` give slots to those that have the fewest bytes. A shard that then has
    less than half the mean, as slots are coarse, gets slots from any that has more by their size.
    """
    out, size = list(old), [sizes.get(s, (0, 0))[0] for s in range(len(old))]
    held = [0] * shards
    for slot, shard in enumerate(out):
        if shard < shards:
            held[shard] += size[slot]
    high = sum(size) / shards * (1 + slack)
    moving = [s for s, shard in enumerate(out) if shard >= shards]
    for slot in sorted((s for s, shard in enumerate(out) if shard < shards), key=lambda s: (size[s], s), reverse=True):
        shard = out[slot]
        # The last slot of a shard stays: moving it would only move the excess.
        if held[shard] > high and held[shard] - size[slot] >= high / (1 + slack) * (1 - slack):
            held[shard] -= size[slot]
            moving.append(slot)
    load = [(h, s) for s, h in enumerate(held)]
    heapq.heapify(load)
    for slot in sorted(moving, key=lambda s: (-size[s], s)):
        h, shard = heapq.heappop(load)
        out[slot] = shard
        held[shard] = h + size[slot]
        heapq.heappush(load, (held[shard], shard))
    for _ in out:
        least = min(range(shards), key=lambda s: (held[s], s))
        fit = [s for s, shard in enumerate(out) if 0 < size[s] < held[shard] - held[least]]
        if held[least] * 2 >= high / (1 + slack) or not fit:
            break
        slot = min(fit, key=lambda s: (max(held[out[s]] - size[s], held[least] + size[s]) - held[out[s]], s))
        held[out[slot]] -= size[slot]
        held[least] += size[slot]
        out[slot] = least
    return out


def map_table(spark: SparkSession, slot_map: list[int], version: int) -> DataFrame:
    """The map as rows (version, virtual_slot, shard)."""
    rows = F.from_json(F.lit(json.dumps(slot_map)), "array<int>")
    return spark.range(1, numPartitions=1).select(F.lit(version).alias("version"), F.posexplode(rows).alias("virtual_slot", "shard"))


def store_map(spark: SparkSession, slot_map: list[int], version: int, path: str) -> None:
    """Add a version to the stored map; earlier versions stay."""
    map_table(spark, slot_map, version).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}").select("virtual_slot", "shard")


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS,
           map_path: str | None = None, version: int = 1, grown: int | None = None) -> DataFrame:
    """Adds size, text_crc32, virtual_slot, shard and slot (the place in the shard)."""
    return assign_slotted(with_slots(df, id_col, text_col, slots), shards, id_col, slots, map_path, version, grown)


def assign_slotted(slotted: DataFrame, shards: int, id_col: str = "doc_id", slots: int = SLOTS,
                   map_path: str | None = None, version: int = 1, grown: int | None = None) -> DataFrame:
    """As ``assign``, for records that have their slots: only the columns given are shuffled.

    With ``grown``, the map edited for that many shards is stored as the next version, and grown_shard is the shard it gives.
    """
    spark = slotted.sparkSession
    sizes = slot_sizes(slotted)
    path = map_path or scratch_path(spark, "slot-map")
    slot_map = new_map(sizes, shards, slots)
    store_map(spark, slot_map, version, path)
    counts = json.dumps([sizes.get(s, (0, 0))[1] for s in range(slots)])
    # ``slots`` rows: the map, and where each slot's places begin in its shard.
    counted = stored_map(spark, path, version).select("virtual_slot", "shard", F.get(F.from_json(F.lit(counts), "array<long>"), F.col("virtual_slot")).alias("_n"))
    if grown is not None:
        store_map(spark, rebalance(slot_map, sizes, grown), version + 1, path)
        counted = counted.join(stored_map(spark, path, version + 1).withColumnRenamed("shard", "_grown"), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begin, place, next_place = free_name(slotted, "_begin"), free_name(slotted, "_shard"), free_name(slotted, "_grown_shard")
    places = counted.select(F.col("virtual_slot"), F.col("shard").alias(place), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(begin),
                            *([] if grown is None else [F.col("_grown").alias(next_place)]))
    rank = Window.partitionBy("virtual_slot").orderBy(col(slotted, id_col), "text_crc32", "size")
    ranked = slotted.withColumn(free_name(slotted, "_rank"), F.row_number().over(rank)).join(F.broadcast(places), "virtual_slot")
    kept = [c for c in slotted.columns if c.lower() not in ("shard", "slot", *([] if grown is None else ["grown_shard"]))]
    return ranked.select(*[col(ranked, c) for c in kept], F.col(place).cast("int").alias("shard"),
                         (F.col(begin) + F.col(free_name(slotted, "_rank")) - 1).cast("long").alias("slot"),
                         *([] if grown is None else [F.col(next_place).cast("int").alias("grown_shard")]))
