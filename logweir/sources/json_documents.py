"""JSON documents that hold a list of records, read by as many tasks as their files have blocks.

The text reader cuts a file at its closing braces, which it can do from any block on. Where a
record begins and ends is known only from what stands before: whether a place is inside a text, and
how deep it is. So every block is scanned once from both possible beginnings (inside a text or not)
and reduced to what it does to depth and text; one small row per block is folded along each file, which gives
every block its true beginning; then the blocks are cut into records independently. A record that
spans blocks leaves a piece in each; only these pieces are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle

_MARK = re.compile(r'["\\\[\]{},]')
_BLOCK = ("file string, block bigint, top string, delta0 int, text0 boolean, opens0 map<int, bigint>, "
          "delta1 int, text1 boolean, opens1 map<int, bigint>")
_BEGIN = "file string, block bigint, level int, depth int, text boolean, lists bigint, active boolean"
_PIECE = "file string, block bigint, no bigint, kind string, record string"


def marks(fragment: str, inside: bool) -> Iterator[tuple[int, str, bool]]:
    """(place, mark, inside a text behind it) of quotes, and of brackets, braces and commas outside texts."""
    skip = -1
    for m in _MARK.finditer(fragment):
        at, c = m.start(), m.group()
        if at == skip:
            continue
        if inside:
            if c == "\\":
                skip = at + 1
            elif c == '"':
                inside = False
                yield at, c, inside
        elif c == '"':
            inside = True
            yield at, c, inside
        elif c != "\\":
            yield at, c, inside


def fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``value, file, block`` of the files, cut behind every closing brace (which is left out)."""
    return spark.read.option("lineSep", "}").text(paths).selectExpr(
        "make_valid_utf8(value) AS value", "_metadata.file_path AS file", "_metadata.file_block_start AS block")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Runs of rows that agree in all columns but the first, with that column's values."""
    rows = ((row[1:], row[0]) for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
    held = next(rows, None)
    while held is not None:
        key, ended = held[0], []

        def values(first):
            yield first
            for k, v in rows:
                if k != key:
                    ended.append((k, v))
                    return
                yield v

        run = values(held[1])
        yield key, run
        for _ in run:
            pass
        held = ended[0] if ended else None


def _effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """What each block does, from either beginning."""
    for (file, block), values in _by_block(batches):
        top = ""
        states = [[0, False, {}], [0, True, {}]]
        for fragment in values:
            fragment += "}"
            top = top or fragment.lstrip("\ufeff \t\r\n")[:1]
            for state in states:
                for _, c, inside in marks(fragment, state[1]):
                    state[1] = inside
                    if c in "[{":
                        # Lists opened at this depth, times two, and whether what was opened here last is one.
                        state[2][state[0]] = (state[2].get(state[0], 0) // 2 + (c == "[")) * 2 + (c == "[")
                        state[0] += 1
                    elif c in "]}":
                        state[0] -= 1
        (d0, t0, o0), (d1, t1, o1) = states
        yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "top": top, "delta0": d0, "text0": t0, "opens0": list(o0.items()),
                                           "delta1": d1, "text1": t1, "opens1": list(o1.items())}], schema=_EFFECT)


_OPENS = pa.map_(pa.int32(), pa.int64())
_EFFECT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("top", pa.string()), ("delta0", pa.int32()), ("text0", pa.bool_()), ("opens0", _OPENS),
                     ("delta1", pa.int32()), ("text1", pa.bool_()), ("opens1", _OPENS)])


def _fold(blocks: pd.DataFrame) -> pd.DataFrame:
    """The true beginning of every block of a file; ``level`` is the depth at which the list of records opens."""
    blocks = blocks.sort_values("block")
    level = 0 if next((t for t in blocks.top if t), "") == "[" else 1
    depth, text, lists, last, out = 0, False, 0, False, []
    for b in blocks.itertuples():
        # Inside the first list: it was opened last at its level, and is not closed.
        out.append((b.file, b.block, level, depth, text, lists, lists == 1 and last and depth > level))
        delta, after, opens = (b.delta1, b.text1, b.opens1) if text else (b.delta0, b.text0, b.opens0)
        found = dict(opens).get(level - depth)
        if found is not None:
            lists, last = lists + found // 2, found % 2 == 1
        depth, text = depth + delta, after
    if depth > 0 or text:
        # The document breaks off: none of its lists counts. (Behind the last brace one too many is read, never one too few.)
        out, lists = [(*b[:5], 2, False) for b in out], 0
    out.append((blocks.file.iloc[0], -1, level, depth, text, lists, False))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _BEGIN.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of the first list, block by block: ``whole``, or the pieces of one that began before or ends later."""
    for (file, block, level, depth, text, lists, active), values in _by_block(batches):
        # Where the first list is open, the block begins inside one of its records.
        out, held, began, no = [], [], not active, 0

        def close(last: bool):
            nonlocal held, began, no
            record = "".join(held)
            if last or record.strip() or not began:
                out.append((file, block, no, ("tail" if began else "middle") if last else ("whole" if began else "head"), record))
                no += 1
            held, began = [], True

        for fragment in values:
            fragment += "}"
            start = 0
            for at, c, inside in marks(fragment, text):
                text = inside
                if c == "," and active and depth == level + 1:
                    held.append(fragment[start:at])
                    close(False)
                    start = at + 1
                elif c in "[{":
                    if c == "[" and depth == level:
                        lists += 1
                        if lists == 1:
                            active, start, began = True, at + 1, True
                    depth += 1
                elif c in "]}":
                    depth -= 1
                    if active and depth == level:
                        held.append(fragment[start:at])
                        close(False)
                        active = False
            if active:
                held.append(fragment[start:])
        if active:
            close(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             names=["file", "block", "no", "kind", "record"])


def tops(cut: DataFrame) -> DataFrame:
    """``file, top``: the first character of every file that is not white space."""
    first = cut.selectExpr("file", "left(ltrim('\ufeff \t\r\n', concat(value, '}')), 1) AS top", "block", "monotonically_increasing_id() AS at").filter("top <> ''")
    return first.groupBy("file").agg(F.expr("min_by(top, struct(block, at))").alias("top"))


def block_effects(cut: DataFrame) -> DataFrame:
    """One small row per block of :func:`fragments`."""
    return cut.select("value", "file", "block").mapInArrow(_effect, _BLOCK)


def records(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``file, record`` of every file's first list, ``file`` of those without a list or that break off).

    Records are texts as they stand in the file. How a file is cut into blocks depends on all files that are
    read together, so ``cut`` is scanned as it is, and a part of its files has to be read anew.
    """
    blocks = settle(block_effects(cut))
    begins = blocks.groupBy("file").applyInPandas(_fold, _BEGIN)
    none = begins.filter("block < 0 AND lists = 0").select("file")
    # Some 100 bytes per block of a JSON document, as for line numbers.
    placed = cut.join(F.broadcast(begins.filter("block >= 0")), ["file", "block"]).select("value", "file", "block", "level", "depth", "text", "lists", "active")
    pieces = placed.mapInArrow(_cut, _PIECE)
    whole = pieces.filter("kind = 'whole'").select("file", "record")
    # A piece goes to the block in which its record began.
    along = Window.partitionBy("file").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.filter("kind <> 'whole'").withColumn("begin", F.last(F.expr("CASE WHEN kind = 'tail' THEN block END"), True).over(along))
    joined = (parts.groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("block", "no", "record"))).alias("ps"))
              .selectExpr("file", "array_join(transform(ps, p -> p.record), '') AS record"))
    return whole.unionByName(joined).filter("record RLIKE '\\\\S'"), none
