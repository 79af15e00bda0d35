"""Vectorised hashes of words, character n-grams and byte windows, for use inside tasks.

A batch of texts is one byte array in which every text is followed by a newline;
all functions work on that array and never look across a text's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: A random 64-bit value per byte.
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Words are runs of bytes other than space and U+0009 to U+000D.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
BATCH_BYTES = 1 << 19
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x + _STEP
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse (mod 2**64)."""
    if len(_powers[0]) < n:
        size = max(n, BATCH_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def batches(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes each; a longer text stands alone."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) + 1 > limit:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def flatten(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte array of a batch, and where each text starts (one entry more than texts)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any range follows; ``symbols`` are 64-bit values."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols))[0], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [first, last); equal content gives equal hashes wherever it stands."""
    return mix((sums[last] - sums[first]) * powers(len(sums))[1][first])


def window_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` symbols, by start."""
    n = len(sums) - length
    return mix((sums[length:] - sums[:n]) * powers(len(sums))[1][:n]) if n > 0 else np.zeros(0, np.uint64)


def tree_hash(symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [first, last), by mixing halves level by level.

    Prefix sums modulo 2**64 collide by construction on texts that double their own complement
    (Thue-Morse words of some 1,000 symbols), whatever base and byte values are. Here every
    level passes through ``mix``, so no algebra of the symbols survives. A range is the two
    windows of the largest power of two that fits, at its ends, and its length; levels up to the
    longest range are built, each as long as ``symbols``.
    """
    size = last - first
    out = mix(size.astype(np.uint64))
    rank = np.frexp(size.astype(np.float64))[1] - 1
    top = int(rank.max()) if len(rank) else -1
    level, width = mix(symbols), 1
    for k in range(top + 1):
        at = np.flatnonzero(rank == k)
        out[at] = mix(mix(level[first[at]] * _BASE + level[last[at] - width]) + size[at].astype(np.uint64) * _STEP)
        if k < top:
            level = mix(level[:-width] * _BASE + level[width:])
            width *= 2
    return out


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    gap = SEPARATORS[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap))))
    return edge[0::2], edge[1::2]


def shingles(texts: list[bytes], width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word shingle, distinct per text and sorted by both.

    A text with fewer words than ``width`` has its whole sequence as its only
    shingle; one without words has none.
    """
    buf, starts = flatten(texts)
    if lower:
        buf = ASCII_LOWER[buf]
    first, last = words(buf)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = tree_hash(BYTE_VALUES[buf], first, last)
    owner = np.searchsorted(starts, first, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(count) - count
    # One shingle per word that has width-1 more behind it, or one per short text.
    number = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), number)
    at = np.repeat(begin - (np.cumsum(number) - number), number) + np.arange(number.sum())
    end = at + np.minimum(count, width)[doc]
    hashes = tree_hash(word, at, end)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or what ``pick`` says) over all windows of ``width`` values, by start."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out
