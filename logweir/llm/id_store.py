"""Token-id files with a minimal perfect hash index.

Documents are range-partitioned and sorted by id, encoded, closed with an end id and
written to shard files. A shard holds raw little-endian ids (16 bits wide if the
vocabulary allows, else 32), where each document starts, and an index: a minimal
perfect hash from document key to a slot that stores a fingerprint, the first row and
the number of rows. A key's shard follows from the shards' key ranges, its slot from a
handful of bit tests. A keyed access bisects the ranges and reads the header, a byte and a rank per level, one entry,
two starts and the payload by their places in the file: the same number of bytes whatever the size.

The hash is built level by level: keys alone at their position of a level's bit array
are placed there, the others go to the next level; the slot is the rank of the bit.

Tasks write to names of their own, and only files in the manifest (rows returned by
tasks that succeeded) are read, so a lost executor costs a repeated task. A task closes
a shard at ``shard_ids`` ids, which bounds memory.

Defined results. A null text is an empty document: only the end id. Rows sharing an id
all get payloads, neighbours in the files; their key leads to the first row and their
number in each shard that has some. Rows without an id come first and have no key. An
empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import hashing as H
from .bpe import codec
from .columns import col
from .files import open_folder

MAGIC = b"LWIDS001"
SHARD_IDS = 16_000_000
# Sizes of the encoder. Nothing else runs in the worker meanwhile, so it may hold more than the encoder does by itself.
REMEMBERED_IDS = 4_000_000
BATCH = 1 << 19
_FINGERPRINT = np.uint64(0x5851F42D4C957F2D)


def key_hash(ids: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit ids: distinct ids, distinct keys."""
    return H.mix(np.asarray(ids, np.int64).view(np.uint64))


@dataclass
class PerfectHash:
    """Levels of packed bits, one after the other; ``sizes`` are their lengths in bits."""

    sizes: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray  # set bits before each byte

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, levels, rest = [], [], keys
        while len(rest):
            size = -8 * (-int(len(rest) * gamma + 8) // 8)
            at = cls.position(rest, len(sizes), size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            levels.append(np.packbits(count == 1))
            rest = rest[count[at] != 1]
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        before = np.cumsum(_ONES[bits], dtype=np.int64)
        return cls(np.array(sizes, np.int64), bits, np.concatenate(([0], before[:-1])) if len(bits) else before)

    @staticmethod
    def position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (H.mix(keys + np.uint64(level * int(_FINGERPRINT) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 where no level has its bit. A strange key may get some slot: compare fingerprints."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + self.position(keys[open_], level, size)
            byte, place = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> (7 - place)) & 1 == 1
            left = self.bits[byte[hit]] >> (8 - place[hit].astype(np.uint16)).astype(np.uint16)
            out[open_[hit]] = self.ranks[byte[hit]] + _ONES[left.astype(np.uint8)]
            open_, base = open_[~hit], base + size
        return out


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (H.mix(keys ^ _FINGERPRINT) >> np.uint64(32)).astype(np.uint32)


def write_shard(folder: str, doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> dict:
    """Write one shard of rows sorted by id; returns its manifest entry."""
    keyed = np.array([d is not None for d in doc_ids], bool)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    lengths = np.array([len(x) for x in ids], np.int64)
    some, first, rows = np.unique(numbers[keyed], return_index=True, return_counts=True)
    keys = key_hash(some)
    index = PerfectHash.build(keys)
    slot = index.slots(keys)
    entries = np.zeros(len(keys), _ENTRY)
    entries["fingerprint"][slot], entries["rows"][slot] = fingerprints(keys), rows
    entries["row"][slot] = np.flatnonzero(keyed)[first] if len(first) else first
    sections = {"doc_ids": numbers.astype("<i8"), "keyed": keyed.astype("u1"), "starts": np.concatenate(([0], np.cumsum(lengths))).astype("<i8"),
                "sizes": index.sizes.astype("<i8"), "bits": index.bits, "ranks": index.ranks.astype("<i8"), "entries": entries,
                "ids": np.concatenate(ids).astype(f"<u{width}")}
    at, directory = 0, {}
    for name, a in sections.items():
        directory[name] = [at, len(a)]
        at += a.nbytes
    head = json.dumps({"width": width, "sections": directory}).encode()
    name = f"{uuid.uuid4().hex}.ids"
    files, path = open_folder(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as out:
        out.write(MAGIC + len(head).to_bytes(4, "little") + head)
        for a in sections.values():
            out.write(a.tobytes())
    return {"name": name, "n_docs": len(ids), "n_ids": int(lengths.sum()), "n_keys": len(keys),
            "low": int(some[0]) if len(some) else None, "high": int(some[-1]) if len(some) else None}


class Shard:
    """A shard file open for keyed access; only the sections asked for are read."""

    def __init__(self, folder: str, name: str):
        files, path = open_folder(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is no shard file")
        size = int.from_bytes(self.file.read(4), "little")
        head = json.loads(self.file.read(size))
        self.width, self.directory, self.base = head["width"], head["sections"], len(MAGIC) + 4 + size

    @cached_property
    def index(self) -> PerfectHash:
        return PerfectHash(self.section("sizes", "<i8"), self.section("bits", "u1"), self.section("ranks", "<i8"))

    @cached_property
    def entries(self) -> np.ndarray:
        return self.section("entries", _ENTRY)

    @cached_property
    def starts(self) -> np.ndarray:
        return self.section("starts", "<i8")

    def section(self, name: str, kind, first: int = 0, count: int | None = None) -> np.ndarray:
        """A section, or ``count`` of its items from ``first``."""
        at, n = self.directory[name]
        kind = np.dtype(kind)
        size = (n if count is None else count) * kind.itemsize
        return np.frombuffer(self.file.read_at(size, self.base + at + first * kind.itemsize), kind)

    def close(self) -> None:
        self.file.close()

    def rows(self, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of every id; 0 rows for an id that is not here."""
        keys = key_hash(doc_ids)
        slot = self.index.slots(keys)
        e = self.entries[np.maximum(slot, 0)] if len(self.entries) else np.zeros(len(keys), self.entries.dtype)
        here = (slot >= 0) & (e["fingerprint"] == fingerprints(keys))
        return e["row"].astype(np.int64), np.where(here, e["rows"], 0).astype(np.int64)

    def payload(self, row: int) -> np.ndarray:
        """The ids of one row, read from their place in the file."""
        a, b = self.section("starts", "<i8", row, 2).tolist()
        return self.section("ids", f"<u{self.width}", a, b - a)

    def look(self, doc_id: int) -> tuple[int, int]:
        """As ``rows`` for one id, reading a byte and a rank of one level's bits after the other and a single entry."""
        keys, base = key_hash(np.array([doc_id])), 0
        for level, size in enumerate(self.section("sizes", "<i8").tolist()):
            at = base + int(PerfectHash.position(keys, level, size)[0])
            byte, place = int(self.section("bits", "u1", at >> 3, 1)[0]), at & 7
            if byte >> (7 - place) & 1:
                slot = int(self.section("ranks", "<i8", at >> 3, 1)[0]) + (byte >> (8 - place)).bit_count()
                e = self.section("entries", _ENTRY, slot, 1)[0]
                return int(e["row"]), int(e["rows"]) if e["fingerprint"] == fingerprints(keys)[0] else 0
            base += size
        return 0, 0

    def get(self, doc_id: int) -> list[np.ndarray]:
        """All payloads stored under an id."""
        row, n = self.look(doc_id)
        return [self.payload(row + k) for k in range(n)]


_ENTRY = np.dtype([("fingerprint", "<u4"), ("row", "<u4"), ("rows", "<u4")])


@dataclass
class IdStore:
    """A folder of shards and its manifest: one entry per shard, in the order of the documents."""

    folder: str
    manifest: list[dict]

    @cached_property
    def keyed(self) -> tuple[list[dict], list[int]]:
        """The shards with keys, in the order of their key ranges, and the ranges' ends."""
        some = [m for m in self.manifest if m["low"] is not None]
        return some, [m["high"] for m in some]

    def shards_of(self, doc_id: int) -> list[dict]:
        some, ends = self.keyed
        first = bisect_left(ends, doc_id)
        return list(takewhile(lambda m: m["low"] <= doc_id, islice(some, first, None)))

    def get(self, doc_id: int) -> list[np.ndarray]:
        out = []
        for m in self.shards_of(doc_id):
            shard = Shard(self.folder, m["name"])
            out += shard.get(doc_id)
            shard.close()
        return out


def write_ids(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
              folder: str | None = None, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> IdStore:
    """Encode all documents and write them, in ascending order of id, to ``folder``."""
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "ids")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(col(df, id_col).cast("long").alias("k"), col(df, text_col).alias("t"))
    # The text's hash splits an id that has very many rows.
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer_file, REMEMBERED_IDS, BATCH)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        keys, held, size, out = [], [], 0, []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            for ids, _ in coder.encode(batch.column(1).to_pylist()):
                held.append(np.append(ids, np.uint32(end_id)).astype(f"<u{width}"))
                size += len(held[-1])
                if size >= shard_ids:
                    out.append(write_shard(folder, keys[: len(held)], held, width))
                    keys, held, size = keys[len(held) :], [], 0
        if held:
            out.append(write_shard(folder, keys, held, width))
        # The worker's next partition has the same words.
        coder.forget(words=False)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "no": i, **m} for i, m in enumerate(out)], schema=_MANIFEST)

    written = (rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
               .mapInArrow(encode, "part long, no long, name string, n_docs long, n_ids long, n_keys long, low long, high long"))
    manifest = sorted((r.asDict() for r in written.collect()), key=lambda m: (m["part"], m["no"]))  # one row per shard
    return IdStore(folder, manifest)


_MANIFEST = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("name", pa.string()), *[(c, pa.int64()) for c in ("n_docs", "n_ids", "n_keys", "low", "high")]])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_back(spark, store: IdStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files through the index."""
    before = np.concatenate(([0], np.cumsum([m["n_ids"] for m in store.manifest]))).astype(int).tolist()
    names, folder = [m["name"] for m in store.manifest], store.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                shard = Shard(folder, names[s])
                stored, keyed = shard.section("doc_ids", "<i8"), shard.section("keyed", "u1").astype(bool)
                ids = shard.section("ids", f"<u{shard.width}")
                rows = [(None, r) for r in np.flatnonzero(~keyed).tolist()]
                some = np.unique(stored[keyed])
                first, count = shard.rows(some)
                rows += [(d, r + k) for d, r, n in zip(some.tolist(), first.tolist(), count.tolist()) for k in range(n)]
                at = shard.starts
                out = [(d, before[s] + int(at[r]), int(at[r + 1] - at[r]), zlib.crc32(ids[at[r] : at[r + 1]].astype("<u4"))) for d, r in rows]
                shard.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_DIGESTS)

    return spark.range(len(names), numPartitions=max(len(names), 1)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
