"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts a text into chunks of about 256 bytes, so
that equal passages give equal chunks wherever they stand. A worker encodes a chunk
once and remembers its ids (tables of bounded size); copies and shared passages cost a
look-up. Chunks end anywhere, so the joins are repaired: what lies between the last
safe cut of one chunk and the first safe cut of the next is encoded again, and the span
grows over whole chunks until it stands on safe cuts at both ends. There the encoding
of the whole text and those of its parts agree exactly.

A safe cut is a place before ASCII white space that follows a character other than
white space: the vocabulary's pre-tokenizer starts a pre-token there whatever comes
before, and its only look-ahead (white space before a character) lies behind the cut.
Merges never cross pre-tokens, so parts between safe cuts encode independently.

Remembered ids are found by a hash, which two byte strings may share. The vocabulary loses
no byte, so ids spell what they were made of: every batch is spelled out and compared with
its bytes, and a piece that differs is encoded again. Tables and batches are small unless a caller
asks for larger ones, and freed at the end of a partition, since a worker lives on for later stages. A text longer than a
batch is a batch of its own: its memory is some dozen times its length.

Defined results. A null text counts as empty: no ids, empty text. Special strings in a
text are matched as the library does by default. Rows are encoded each for itself, an
empty table gives no rows, and extra columns pass through; result columns replace input
columns of the same name.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .columns import col, free_name, utf8, with_result
from .memory import trim

CHUNK_BITS = 8
REMEMBERED_IDS = 500_000
BATCH = 1 << 18


def ragged(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges [first, first + size) of ``pool``, one after the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Remembered:
    """Hash of a byte string -> its ids. Starts anew when more than ``limit`` ids are held."""

    def __init__(self, limit: int = REMEMBERED_IDS):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, keys: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all keys joined, number of ids of each); ``encode`` does so for positions of new keys."""
        some, where, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, some), max(len(self.keys) - 1, 0))
        known = self.keys[at] == some if len(self.keys) else np.zeros(len(some), bool)
        first, size = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        if len(self.keys):
            first[known], size[known] = self.first[at[known]], self.size[at[known]]
        pool = self.pool
        if not known.all():
            new_ids, new_size = encode(where[~known])
            size[~known] = new_size
            first[~known] = len(pool) + np.cumsum(new_size) - new_size
            pool = np.concatenate((pool, new_ids))
            if len(pool) > self.limit:
                self.clear()
            else:
                merged = np.concatenate((self.keys, some[~known]))
                order = np.argsort(merged, kind="stable")
                self.keys, self.pool = merged[order], pool
                self.first = np.concatenate((self.first, first[~known]))[order]
                self.size = np.concatenate((self.size, size[~known]))[order]
        return ragged(pool, first[back], size[back]), size[back]


class ChunkCodec:
    """Encodes and decodes as the tokenizer file's own library does."""

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED_IDS, batch: int = BATCH):
        # One core per task is what Spark counts on.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        pieces = piece_bytes(self.tokenizer)
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_first = np.cumsum(self.piece_size) - self.piece_size
        self.piece_pool = np.frombuffer(b"".join(pieces), np.uint8)
        self.batch = batch
        self.words, self.chunks = Remembered(remembered), Remembered(remembered)

    def library_ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings cut at safe places, by the library.

        Parts that start with white space and end without are encoded joined to one
        text; its ids fall apart at the parts' ends, which byte counts show.
        """
        space = [(p[0] in _SPACES, p[-1] in _SPACES or (p[-1] >= 0x80 and p[-4:].decode("utf-8", "ignore")[-1:].isspace())) for p in parts]
        joined = [i for i, s in enumerate(space) if s == (True, False)]
        alone = [i for i, s in enumerate(space) if s != (True, False)]
        texts = [p.decode("utf-8") for p in ([parts[i] for i in alone] + [b"".join(parts[i] for i in joined)])]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.zeros(len(parts), np.int64)
        size[alone] = [len(ids) for ids in found[:-1]]
        if joined:
            ends = np.searchsorted(np.cumsum(self.piece_size[found[-1]]), np.cumsum([len(parts[i]) for i in joined])) + 1
            size[joined] = np.diff(ends, prepend=0)
        made = np.array(alone + joined, np.int64)
        first = np.zeros(len(parts), np.int64)
        first[made] = np.cumsum(size[made]) - size[made]
        return ragged(np.concatenate(found), first, size), size

    def encode_batch(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts joined, number of ids of each, the bytes that the ids spell)."""
        buf, starts = H.flatten(raw)
        begin, end = starts[:-1], starts[1:] - 1
        sums = H.prefix_sums(H.BYTE_VALUES[buf])
        cuts = safe_cuts(buf)
        owner = np.searchsorted(starts, cuts, "right") - 1
        cuts = cuts[(cuts > begin[owner]) & (cuts < end[owner])]
        # Safe cuts next to a chunk's ends, inside the chunk: bodies lie between the two, joins between bodies.
        edges = np.unique(np.concatenate((chunk_ends(buf, CHUNK_BITS), starts)))
        edges = edges[edges < len(buf)]
        after, before = np.searchsorted(cuts, edges, "right"), np.searchsorted(cuts, edges, "left") - 1
        marks = np.concatenate((cuts[after[after < len(cuts)]], cuts[before[before >= 0]], begin))
        pieces = np.unique(marks[marks < len(buf)])
        piece_end = np.append(pieces[1:], len(buf))
        last = np.searchsorted(starts, pieces, "right")
        piece_end = np.minimum(piece_end, starts[last] - 1)
        full = piece_end > pieces
        pieces, piece_end = pieces[full], piece_end[full]

        def words_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Encode pieces word by word."""
            a, b = np.searchsorted(cuts, pieces[some], "right"), np.searchsorted(cuts, piece_end[some], "left")
            inner = np.maximum(b - a, 0)
            total = inner + 1
            at = np.cumsum(total) - total
            first = np.zeros(total.sum(), np.int64)
            first[at] = pieces[some]
            rest = np.ones(len(first), bool)
            rest[at] = False
            first[rest] = ragged(cuts, a, inner)
            stop = np.append(first[1:], 0)
            stop[at + total - 1] = piece_end[some]
            data = buf.tobytes()
            ids, size = self.words.ids(H.range_hash(sums, first, stop), lambda new: self.library_ids(
                [data[x:y] for x, y in zip(first[new].tolist(), stop[new].tolist())]))
            return ids, np.add.reduceat(size, at)

        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(raw), np.int64), np.zeros(0, np.uint8)
        ids, size = self.chunks.ids(H.range_hash(sums, pieces, piece_end), words_of)
        spelled, source = self.spell(ids), ragged(buf, pieces, piece_end - pieces)
        if len(spelled) != len(source) or not np.array_equal(spelled, source):
            ids, size = self.mended(ids, size, [buf[x:y].tobytes() for x, y in zip(pieces.tolist(), piece_end.tolist())])
            spelled = self.spell(ids)
        text = np.searchsorted(starts, pieces, "right") - 1
        return ids, np.bincount(text, size, len(raw)).astype(np.int64), spelled

    def mended(self, ids: np.ndarray, size: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, where those that spell other bytes than their piece are made anew."""
        parts = np.split(ids, np.cumsum(size)[:-1])
        wrong = [k for k, (p, own) in enumerate(zip(parts, pieces)) if self.spell(p).tobytes() != own]
        fresh, n = self.library_ids([pieces[k] for k in wrong])
        for k, p in zip(wrong, np.split(fresh, np.cumsum(n)[:-1])):
            parts[k] = p
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each text, and the bytes that they spell."""
        raw = [utf8(t) for t in texts]
        for a, b in H.batches(raw, self.batch):
            ids, size, spelled = self.encode_batch(raw[a:b])
            end = np.cumsum(size)
            stop = np.concatenate(([0], np.cumsum(self.piece_size[ids])))[end]
            for i, j, x, y in zip((end - size).tolist(), end.tolist(), [0, *stop.tolist()], stop.tolist()):
                yield ids[i:j], spelled[x:y].tobytes()

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, joined."""
        return ragged(self.piece_pool, self.piece_first[ids], self.piece_size[ids])

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return self.spell(ids).tobytes().decode("utf-8", "replace")

    def forget(self, words: bool = True) -> None:
        """Drop the tables (``words``: that of single words too) and the memory of the last batches."""
        if words:
            self.words.clear()
        self.chunks.clear()
        trim()




_SPACES = frozenset(b" \t\n\x0b\x0c\r")


def safe_cuts(buf: np.ndarray) -> np.ndarray:
    """Positions of ASCII white space behind anything but white space (of any kind)."""
    gap = H.SEPARATORS[buf]
    at = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    wide = at[buf[at - 1] >= 0x80]
    # Last bytes of white space outside ASCII: U+0085, U+00A0; U+1680, U+2000 to U+205F, U+3000.
    two, three = buf[np.maximum(wide - 2, 0)], buf[np.maximum(wide - 3, 0)]
    doubt = (two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    return np.setdiff1d(at, wide[doubt], assume_unique=True) if doubt.any() else at


def chunk_ends(buf: np.ndarray, bits: int) -> np.ndarray:
    """Positions behind 16 bytes whose hash has ``bits`` leading zero bits."""
    if len(buf) < 17:
        return np.zeros(0, np.int64)
    value, have, factor = H.BYTE_VALUES[buf], 1, 0x9E3779B97F4A7C15
    while have < 16:
        value = value[: len(value) - have] * np.uint64(pow(factor, have, 1 << 64)) + value[have:]
        have *= 2
    return np.flatnonzero((value >> np.uint64(64 - bits)) == 0) + 16


def piece_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id: printable stand-ins turned back into bytes, special strings as they are."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in shown}
    stand_in |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    pieces = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return [p.encode() if p in special or any(c not in stand_in for c in p) else bytes(stand_in[c] for c in p) for p in pieces]


@cache
def codec(tokenizer_file: str, remembered: int = REMEMBERED_IDS, batch: int = BATCH) -> ChunkCodec:
    """One codec per worker, tokenizer file and sizes."""
    return ChunkCodec(tokenizer_file, remembered, batch)


def encode_decode(df: DataFrame, tokenizer_file: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded.

    ``tokenizer_file`` must be readable on every executor. A digest is that of the ids
    as little-endian unsigned 32-bit integers, or of the decoded text in UTF-8.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kinds = ["long", "string", "string", "array<int>", "string"]

    @F.pandas_udf(",".join(f"{n} {k}" for n, k in zip(names, kinds)))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = codec(tokenizer_file)
        for texts in batches:
            rows = []
            for ids, spelled in coder.encode(list(texts)):
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4")).hexdigest(), hashlib.sha256(spelled).hexdigest(),
                             *((ids.astype(np.int32), spelled.decode("utf-8", "replace")) if with_ids else ())))
            yield pd.DataFrame(rows, columns=names)
        coder.forget()

    hidden = free_name(df, "_bpe")
    held = df.withColumn(hidden, run(col(df, text_col)))
    return with_result(held, **{n: F.col(hidden)[n] for n in names}).drop(hidden)
