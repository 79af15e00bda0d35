"""Fill-in-the-middle transformation with piece tables.

A document is a row of descriptors (buffer, start, stop) over immutable buffers: its text
in UTF-8, and the sentinels. Cutting splits descriptors, an arrangement permutes them and
puts sentinels between, the inverse permutation restores the text, and digests stream over
the descriptors; no text is moved before it is written out.

Where a document is cut, and whether it is arranged at all, follows from the first four
32-bit groups h1 to h4 of sha256("<seed>:<id>"): the prefix ends after the smaller of
h1 mod (n+1) and h2 mod (n+1) code points, the middle after the larger; h3 mod 100 at or
above ``fim_percent`` leaves the text plain; h4 mod 100 below ``spm_percent`` puts the
suffix first. A text that is empty or holds a sentinel stays plain, so an output falls
apart at its sentinels in one way only: a sentinel begins with "<" and holds no other, so
none arises where text meets one.

Rows are worked on one by one in an Arrow pass without a shuffle; a task holds one batch of
texts and, of the document at hand, its output.

Defined results. A null text counts as empty and is plain. A null id gives the digest of
"<seed>:". Rows that share an id are cut by the same h1 to h4; repeated rows give repeated
results, an empty table none. Very long texts are taken whole. Other columns pass through;
result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col, free_name, utf8, with_result

# --- fixed values: the sentinels, and the order of the parts in the two forms ---------
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
LAYOUT = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
ORIGINAL = ("prefix", "middle", "suffix")
FIM_PERCENT, SPM_PERCENT, SEED = 90, 20, 1

Piece = tuple[bytes, int, int]


@dataclass(frozen=True)
class PieceTable:
    """A byte sequence as descriptors over immutable buffers."""

    pieces: tuple[Piece, ...]

    @classmethod
    def of(cls, buffer: bytes) -> PieceTable:
        return cls(((buffer, 0, len(buffer)),))

    def cut(self, offsets: list[int]) -> list[PieceTable]:
        """The stretches between rising byte offsets, and what is before and behind them; descriptors are split, bytes stay."""
        parts: list[list[Piece]] = [[]]
        left, at = sorted(offsets), 0
        for buffer, start, stop in self.pieces:
            while left and left[0] < at + stop - start:
                split = start + left.pop(0) - at
                parts[-1].append((buffer, start, split))
                at, start = at + split - start, split
                parts.append([])
            parts[-1].append((buffer, start, stop))
            at += stop - start
        parts += [[] for _ in left]
        return [PieceTable(tuple(p for p in part if p[1] < p[2])) for part in parts]

    def __add__(self, other: PieceTable) -> PieceTable:
        return PieceTable(self.pieces + other.pieces)

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, stop in self.pieces:
            yield memoryview(buffer)[start:stop]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.stream():
            digest.update(view)
        return digest.hexdigest()

    def __bytes__(self) -> bytes:
        return b"".join(self.stream())


def arrange(parts: dict[str, PieceTable], form: str) -> PieceTable:
    """The parts in the form's order, each behind its sentinel."""
    out = PieceTable(())
    for name in LAYOUT[form]:
        out = out + PieceTable.of(SENTINELS[name]) + parts[name]
    return out


def restore(output: bytes, form: str) -> PieceTable:
    """The original text from an output and its form, as descriptors over the output."""
    if form == "plain":
        return PieceTable.of(output)
    bounds, at = [], 0
    for name in LAYOUT[form]:
        mark = SENTINELS[name]
        begin = output.index(mark, at)
        at = begin + len(mark)
        bounds += [begin, at]
    # Before the first sentinel stands nothing; then come sentinel and part in turn.
    cut = PieceTable.of(output).cut(bounds)
    parts = dict(zip(LAYOUT[form], cut[2::2]))
    out = PieceTable(())
    for name in ORIGINAL:
        out = out + parts[name]
    return out


def draws(digest: str) -> tuple[int, int, int, int]:
    """h1 to h4."""
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def transform(text: str | None, digest: str, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, PieceTable]:
    """(code points, form, code points of prefix and of middle, output)."""
    text = text or ""
    raw = utf8(text)
    n = len(text)
    h1, h2, h3, h4 = draws(digest)
    if not n or h3 % 100 >= fim_percent or any(mark in raw for mark in SENTINELS.values()):
        return n, "plain", None, None, PieceTable.of(raw)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = len(utf8(text[:first]))
    prefix, middle, suffix = PieceTable.of(raw).cut([at, at + len(utf8(text[first:second]))])
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, first, second - first, arrange({"prefix": prefix, "middle": middle, "suffix": suffix}, form)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   seed: int = SEED, with_texts: bool = False) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked for, output and restored."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output", "restored"] if with_texts else [])]
    kinds = ["long", "string", "long", "long", "string", "string", "string", "string"]

    @F.pandas_udf(",".join(f"{n} {k}" for n, k in zip(names, kinds)))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, digests in batches:
            columns: dict[str, list] = {n: [] for n in names}
            for text, digest in zip(texts, digests):
                n, form, prefix, middle, table = transform(text, digest, fim_percent, spm_percent)
                output = bytes(table)
                back = restore(output, form)
                row = (n, form, prefix, middle, table.sha256(), back.sha256(), *((output.decode(), bytes(back).decode()) if with_texts else ()))
                for name, value in zip(names, row):
                    columns[name].append(value)
            yield pd.DataFrame({n: pd.array(v, "Int64") if n in ("prefix_chars", "middle_chars") else pd.Series(v, dtype="int64" if n == "n" else object)
                                for n, v in columns.items()})

    hidden = free_name(df, "_fim")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(col(df, id_col).cast("string"), F.lit(""))), 256)
    held = df.withColumn(hidden, run(col(df, text_col), digest))
    return with_result(held, **{n: F.col(hidden)[n] for n in names}).drop(hidden)


#: DuckDB SQL for the query's rows.
SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
    ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
