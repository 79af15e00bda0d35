"""Document fingerprints: quartile bucket digests, and how like each document is to its neighbour.

Byte triplets of a window of five bytes are hashed to ``BUCKETS`` buckets and counted; a
bucket is written as the quartile of the counts it falls in (two bits), beside the text's
length on a logarithmic scale (one byte). Two digests differ by what their buckets' quartiles
differ (0, 1, 2 or ``FAR`` for 3), held against what two digests with these quartiles would
differ if their buckets were dealt at random, plus a share for unlike lengths. This
difference is bounded by 1; likeness is 1 minus it. So short texts, most of whose buckets
are empty, are judged on the same scale as long ones.

``with_neighbours`` compares each document with the next one in ascending order of id and
with an edited form of itself, whose last quarter is the beginning of the next one. Rows are
range-partitioned and sorted by id, text hash and place in the scan (one shuffle of the texts; an id or
a row that holds a third of all rows is split by the last two). Every row meets its
next one in the same task; the last row of a partition waits, with its text, in the written
result for the first row of the following partition, so one row per partition is joined, and
nothing passes through the driver.

Defined results. A null text counts as empty; empty texts have the digest of no triplets,
and two of them are alike (1). Null ids come first; rows that share an id follow each other by
text hash; equal rows are each other's neighbours. The last row's next one is the first; the
only row is its own. An empty table gives no rows. Texts are taken whole; a text longer than a
batch is a batch of its own. Other columns pass through, the text does not; result columns
replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import hashing as H
from .chunks import stored
from .columns import col, utf8
from .memory import trim

BUCKETS = 256
#: Triplets of a window: its first byte and two of the four behind it.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
FAR = 6
COST = np.array([[(0, 1, 2, FAR)[abs(a - b)] for b in range(4)] for a in range(4)], np.float64)
#: Lengths count as steps of 10 %; each step of difference beyond the first costs this much of the likeness, up to a limit.
LENGTH_STEP, LENGTH_COST, LENGTH_LIMIT = np.log(1.1), 0.02, 0.3
RESULTS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def bucket_counts(raw: list[bytes]) -> np.ndarray:
    """Triplets per bucket (a row per text)."""
    size = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    text = np.repeat(np.arange(len(raw)), size)
    end = np.repeat(np.cumsum(size), size)
    out = np.zeros(len(raw) * BUCKETS, np.int64)
    for k, (i, j) in enumerate(TRIPLETS):
        n = len(buf) - j
        if n <= 0:
            continue
        inside = np.flatnonzero(np.arange(j, len(buf)) < end[:n])
        key = (buf[inside] << 16 | buf[inside + i] << 8 | buf[inside + j]) + np.uint32(k << 24)
        key = (key ^ key >> 15) * np.uint32(0x2C1B3C6D)
        key = (key ^ key >> 12) * np.uint32(0x297A2D39)
        out += np.bincount(text[inside] * BUCKETS + ((key ^ key >> 15) & BUCKETS - 1), minlength=len(out))
    return out.reshape(len(raw), BUCKETS)


def quartiles(counts: np.ndarray) -> np.ndarray:
    """Per bucket 0 to 3: in which quarter of the row's counts its count is; equal counts share the lower one."""
    ranked = np.sort(counts, axis=1)
    out = np.zeros(counts.shape, np.uint8)
    for k in (1, 2, 3):
        out += counts > ranked[:, k * BUCKETS // 4 - 1 : k * BUCKETS // 4]
    return out


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket quartiles, length steps), a row per text."""
    raw = [utf8(t) for t in texts]
    parts = [quartiles(bucket_counts(raw[a:b])) for a, b in H.batches(raw)]
    codes = np.concatenate(parts) if parts else np.zeros((0, BUCKETS), np.uint8)
    size = np.array([len(r) for r in raw], np.float64)
    return codes, np.minimum(np.log1p(size) / LENGTH_STEP, 255).astype(np.int64)


def written(codes: np.ndarray, steps: np.ndarray) -> list[str]:
    """Digests as hexadecimal text: the length, then four buckets a byte."""
    four = codes.reshape(len(codes), BUCKETS // 4, 4)
    packed = (four[..., 0] << 6 | four[..., 1] << 4 | four[..., 2] << 2 | four[..., 3]).astype(np.uint8)
    return [f"{s:02x}{row.tobytes().hex()}" for s, row in zip(steps.tolist(), packed)]


def read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``written``."""
    data = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1)
    codes = np.stack([data[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(data), -1)
    return codes, data[:, 0].astype(np.int64)


def likeness(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 minus the bounded difference, row by row."""
    (a, m), (b, n) = one, two
    found = COST[a, b].sum(axis=1)
    shares = [np.stack([(x == k).sum(axis=1) for k in range(4)], axis=1) for x in (a, b)]
    expected = np.einsum("ri,ij,rj->r", shares[0], COST, shares[1]) / BUCKETS
    # Without any spread there is nothing to expect; then digests are equal or as unlike as can be.
    buckets = np.where(expected > 0, found / np.maximum(expected, 1e-9), np.where(found > 0, 1.0, 0.0))
    length = np.minimum(np.maximum(np.abs(m - n) - 1, 0) * LENGTH_COST, LENGTH_LIMIT)
    return 1 - np.minimum(buckets + length, 1)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text, or by all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compared(texts: list[str], following: list[str], own: tuple[np.ndarray, np.ndarray], nexts: tuple[np.ndarray, np.ndarray]) -> dict[str, list]:
    """The result columns that need the next text."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    new = digests(changed)
    return {"edited_sha256": [hashlib.sha256(utf8(t)).hexdigest() for t in changed], "edited_fingerprint": written(*new),
            "near_edited": likeness(own, new).tolist(), "near_next": likeness(own, nexts).tolist()}


_OWN = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, first_text string, last_text string"


def with_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the text, with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kept = [c for c in df.columns if c != text_col and c.lower() not in RESULTS]
    text = F.coalesce(col(df, text_col), F.lit(""))
    rows = df.select(*[col(df, c).alias(f"c{i}") for i, c in enumerate(kept)], col(df, id_col).alias("_k"), text.alias("_t"))
    order = [F.col("_k").asc_nulls_first(), F.col("_h"), F.col("_m")]
    rows = rows.withColumn("_h", F.xxhash64("_t")).withColumn("_m", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*[f"c{i}" for i in range(len(kept))], "_t")
    schema = StructType([f for f in ordered.schema if f.name != "_t"] + list(StructType.fromDDL(_OWN)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: tuple[pa.Table, str, tuple] | None = None
        first = True

        def out(table: pa.Table, texts: list[str], own: tuple, result: dict[str, list], last: bool) -> pa.RecordBatch:
            nonlocal first
            n = len(texts)
            columns = {"n_chars": [len(t) for t in texts], "fingerprint": written(*own), "part": [part] * n,
                       "first_text": [texts[0] if first and not i else None for i in range(n)], "last_text": [texts[0] if last else None] * n, **result}
            first = False
            names = [c.split()[0] for c in _OWN.split(", ")]
            kinds = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            arrays = [c.combine_chunks() for c in table.columns]
            return pa.RecordBatch.from_arrays([*[a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays],
                                               *[pa.array(columns.get(c, [None] * n), k) for c, k in zip(names, kinds)]], names=[*table.column_names, *names])

        for batch in batches:
            texts = batch.column("_t").to_pylist()
            table = pa.Table.from_batches([batch]).drop_columns(["_t"])
            for a, b in H.batches([utf8(t) for t in texts]):
                some, own = texts[a:b], digests(texts[a:b])
                rows_here = table.slice(a, b - a)
                if held is not None:
                    rows_here = pa.concat_tables([held[0], rows_here])
                    some = [held[1], *some]
                    own = tuple(np.concatenate(x) for x in zip(held[2], own))
                n = len(some) - 1
                before = tuple(x[:n] for x in own)
                if n:
                    yield out(rows_here.slice(0, n), some[:n], before, compared(some[:n], some[1:], before, tuple(x[1:] for x in own)), False)
                held = rows_here.slice(n, 1), some[n], tuple(x[n:] for x in own)
        if held is not None:
            yield out(held[0], [held[1]], held[2], {}, True)
        trim()

    done = stored(ordered.mapInArrow(run, schema), "digests")
    firsts = done.where("first_text IS NOT NULL").select(F.col("part").alias("_p"), F.col("first_text").alias("_text"), F.col("fingerprint").alias("_print"))
    # One number per partition: which partition with rows comes next, and the first one behind the last.
    parts = Window.orderBy("_p")
    follows = firsts.select(F.col("_p").alias("part"), F.coalesce(F.lead("_p").over(parts), F.min("_p").over(Window.partitionBy())).alias("_p"))

    @F.pandas_udf("edited_sha256 string, edited_fingerprint string, near_edited double, near_next double")
    def close(texts: pd.Series, own: pd.Series, following: pd.Series, nexts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(compared(list(texts), list(following), read(list(own)), read(list(nexts))))

    ends = done.where("last_text IS NOT NULL").join(follows, "part").join(firsts, "_p").withColumn("_c", close("last_text", "fingerprint", "_text", "_print"))
    passed = [f"c{i}" for i in range(len(kept))]
    closed = ends.select(*passed, *[F.col(f"_c.{c}").alias(c) if c not in ("n_chars", "fingerprint") else F.col(c) for c in RESULTS])
    every = done.where("last_text IS NULL").select(*passed, *RESULTS).unionByName(closed)
    return every.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *RESULTS)
