"""A working copy of a table in chunk files, and packed exchanges between chunks and hash buckets.

Some operators look at every few bytes of every text. As rows, such values would cost
more to move than the texts. Here a task packs them into byte strings, one per hash
bucket; Spark shuffles these strings by bucket, the bucket's task answers with one
string per sender, and these go back to the sender's chunk in a second shuffle. The
sender reads its own file again, so an answer needs no more than a few bits per value,
in the order in which the values were sent. Nothing is kept in workers between stages:
a lost task reads its file again.

A chunk file is read in parts of about ``PART_BYTES`` of text, cut at the same rows each
time, which bounds memory whatever the size of the file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shuffles_freed
from .files import listed, open_folder
from .memory import trim

PART_BYTES = 3 << 20
#: Bytes of compressed text for each hash bucket, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 64
PACKED = "bucket int, chunk long, part int, data binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


@dataclass(frozen=True)
class Chunks:
    """A folder of Parquet files; file k is chunk k. Columns are called c0, c1 ... in the table's order."""

    folder: str
    names: tuple[str, ...]
    buckets: int
    ident: str
    text: str
    columns: tuple[str, ...]

    @classmethod
    def write(cls, df: DataFrame, purpose: str, id_col: str, text_col: str) -> Chunks:
        """Write a working copy of ``df``: no shuffle, one file per task."""
        folder = scratch_path(df.sparkSession, purpose)
        columns = tuple(f"c{i}" for i in range(len(df.columns)))
        with shuffles_freed(df.sparkSession):
            df.toDF(*columns).write.parquet(folder)
        files = listed(folder, ".parquet")
        size = sum(s for _, s in files)
        at = {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}
        return cls(folder, tuple(n for n, _ in files), max(LEAST_BUCKETS, size // BUCKET_BYTES), at[id_col], at[text_col], columns)

    def ids(self, spark: SparkSession) -> DataFrame:
        """One row per chunk, each in a partition of its own."""
        return spark.range(len(self.names), numPartitions=max(len(self.names), 1)).select(F.col("id").alias("chunk"))

    def parts(self, chunk: int, columns: list[str] | None = None) -> Iterator[pa.Table]:
        """The chunk's rows, in parts."""
        files, path = open_folder(self.folder)
        with files.open_input_file(f"{path}/{self.names[chunk]}") as f:
            held, size = [], 0
            for batch in pq.ParquetFile(f).iter_batches(batch_size=256, columns=columns):
                held.append(batch)
                size += batch.column(batch.schema.get_field_index(self.text)).nbytes
                if size >= PART_BYTES:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
            if held:
                yield pa.Table.from_batches(held)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    """(bucket, chunk, part, data) rows as one batch."""
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PACKED.types)], schema=_PACKED)


def from_chunks(chunks: Chunks, spark: SparkSession, send: Callable[[int], Iterator[list[tuple]]]) -> DataFrame:
    """Packed rows that ``send`` makes of every chunk; it yields a list of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                for rows in send(chunk):
                    yield packed(rows)
        trim()

    return chunks.ids(spark).mapInArrow(run, PACKED)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with equal ``key`` in sorted batches."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def in_buckets(sent: DataFrame, answer: Callable[[list[dict]], list[tuple]], partitions: int) -> DataFrame:
    """Shuffle by bucket; ``answer`` turns all rows of a bucket into packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "bucket"):
            yield packed(answer(rows))
        trim()

    return sent.repartition(partitions, "bucket").sortWithinPartitions("bucket", "chunk", "part").mapInArrow(run, PACKED)


def to_chunks(answers: DataFrame, chunks: Chunks, receive: Callable[[int, list[dict]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Shuffle answers to their chunk; ``receive`` gets them sorted by part and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in grouped(batches, "chunk"):
            yield from receive(chunk, rows)
        trim()

    return answers.repartition(max(len(chunks.names), 1), "chunk").sortWithinPartitions("chunk", "part", "bucket").mapInArrow(run, schema)


def stored(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write rows to the shared folder and go on from there: no lineage, and sizes that the planner knows.

    A ``path`` taken before ``temporary`` began outlives it.
    """
    path = path or scratch_path(df.sparkSession, purpose)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
