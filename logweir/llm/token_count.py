"""Token counts of a piece vocabulary, by rank-synchronous array merging.

Batched pre-tokens are ragged numpy arrays: one flat array of symbols, cut by
sequence ends. In each round every sequence applies its lowest-rank pair at once; the
symbols that survive are the tokens (a symbol outside the vocabulary counts as its
UTF-8 bytes, the vocabulary's byte fallback). Each task counts a pre-token once and
remembers it in a table of bounded size.

Pre-tokens are cut before every word-start mark that follows another character. No
piece of the vocabulary holds a mark behind another character (checked on loading),
so no merge can cross such a cut.

A long pre-token without a cut (letters without spaces, ideographs, base64) keeps a work list instead: the places of
every pair by its rank. Ranks are taken in order, all places of one at once, overlapping ones from the left, and only the
pairs beside them are looked at again, so the work does not grow with the square of the length. Where a
new symbol makes a pair of lower rank with a neighbour (possible for pieces found on loading), that pair comes before the
places behind it.

Defined results. A null text counts as empty: 0 bytes, 0 tokens. Rows are counted each
for itself. An empty table gives no rows. Extra columns pass through; result columns
replace input columns of the same name.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col, utf8_length, with_result

MARK = "▁"
#: Pre-tokens that a worker remembers; more are counted again when they are met again.
REMEMBERED = 800_000
#: Longer pre-tokens are merged by work list.
LONG = 512
_PRE_TOKENS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCounter:
    """Counts tokens as the vocabulary's own library does."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal = [i for i in range(self.library.get_piece_size())
                  if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        pieces = {self.library.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word start inside: pre-tokens cannot be cut apart")
        #: Symbols are numbers: pieces by falling score (their rank), then characters met outside the vocabulary.
        ranked = sorted(pieces, key=lambda p: (-self.library.get_score(pieces[p]), pieces[p]))
        self.rank = {p: r for r, p in enumerate(ranked)}
        self.pieces = len(ranked)
        left, right, merged = [], [], []
        self.overtaken = np.zeros(self.pieces + 1, bool)
        for p, r in self.rank.items():
            for k in range(1, len(p)):
                if p[:k] in self.rank and p[k:] in self.rank:
                    left.append(self.rank[p[:k]])
                    right.append(self.rank[p[k:]])
                    merged.append(r)
                    for part in (left[-1], right[-1]):
                        self.overtaken[part] |= part > r
        key = np.array(left, np.int64) * self.pieces + np.array(right, np.int64)
        order = np.argsort(key)
        self.pair, self.merged = key[order], np.array(merged, np.int64)[order]
        self.remembered: dict[str, int] = {}

    def pair_ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of the piece that two neighbours make, or the number of pieces."""
        key = np.where((first < self.pieces) & (second < self.pieces), first * self.pieces + second, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], self.pieces)

    def merge(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply, in every sequence at once, its lowest-rank pair (the first of equals) until none is left."""
        done_symbols, done_owner = [], []
        rank = np.full(len(symbols), self.pieces, np.int64)  # of the pair that starts here
        at = np.flatnonzero(owner[1:] == owner[:-1])
        rank[at] = self.pair_ranks(symbols[at], symbols[at + 1])
        while len(symbols):
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbols)))
            # Sequences without a pair are finished and leave the arrays.
            over = np.repeat(lowest == self.pieces, size)
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            symbols, owner, rank, lowest = symbols[~over], owner[~over], rank[~over], np.repeat(lowest, size)[~over]
            hit = np.flatnonzero(rank == lowest)
            if not len(hit):
                break
            hit = hit[np.concatenate(([True], owner[hit][1:] != owner[hit][:-1]))]
            symbols[hit] = rank[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # one symbol went in every sequence before
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # Only pairs with the new symbol have another rank than before.
            for at in (hit, hit[hit > 0] - 1):
                near = at[at + 1 < len(symbols)]
                rank[at] = np.where(at + 1 < len(symbols), rank[at], self.pieces)
                same = owner[near] == owner[near + 1]
                rank[near[~same]] = self.pieces
                rank[near[same]] = self.pair_ranks(symbols[near[same]], symbols[near[same] + 1])
        return np.concatenate([symbols[:0], *done_symbols]), np.concatenate([owner[:0], *done_owner])

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long sequence, by work list; gives the symbols that survive."""
        n, s = len(symbols), symbols.copy()
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank = np.full(n, self.pieces, np.int64)
        rank[:-1] = self.pair_ranks(s[:-1], s[1:])
        ranks: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def push(at: np.ndarray) -> None:
            at = at[np.argsort(rank[at], kind="stable")]
            found, first = np.unique(rank[at], return_index=True)
            for r, part in zip(found.tolist(), np.split(at, first[1:])):
                if r not in places:
                    heapq.heappush(ranks, r)
                places.setdefault(r, []).append(part)

        push(np.flatnonzero(rank < self.pieces))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # Of places that overlap in a chain, every other one from the left.
            every, chained = at, np.concatenate(([False], after[at[:-1]] == at[1:]))
            begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if self.overtaken[r]:
                # Up to the first place whose new symbol makes a pair of lower rank; that pair comes before the rest.
                behind, left = after[after[at]], before[at]
                ahead = np.concatenate(([False], behind[:-1] == at[1:]))
                low = self.pair_ranks(np.full(len(at), r), np.where(behind < n, s[np.minimum(behind, n - 1)], self.pieces)) < r
                low |= self.pair_ranks(np.where(ahead, r, np.where(left >= 0, s[left], self.pieces)), np.full(len(at), r)) < r
                if low.any():
                    at = at[: int(np.argmax(low)) + 1]
                    rest = every[every > at[-1]]
                    if len(rest):
                        heapq.heappush(ranks, r)
                        places[r] = [rest]
            gone = after[at]
            s[at], alive[gone], rank[gone] = r, False, self.pieces
            after[at] = after[gone]
            inside = at[after[at] < n]
            before[after[inside]] = inside
            rank[at] = self.pieces
            left = before[at]
            near = np.concatenate((inside, left[left >= 0]))
            rank[near] = self.pair_ranks(s[near], s[after[near]])
            push(near[rank[near] < self.pieces])
        return s[alive]

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        if not pre_tokens:
            return np.zeros(0, np.int64)
        # Characters outside the vocabulary are numbered behind the pieces, by their bytes.
        outside: dict[str, int] = {}
        flat = [self.rank[c] if c in self.rank else self.pieces + outside.setdefault(c, len(outside)) for t in pre_tokens for c in t]
        width = np.ones(self.pieces + len(outside), np.int64)
        width[self.pieces:] = [len(c.encode("utf-8", "surrogatepass")) for c in outside]
        size = np.array([len(t) for t in pre_tokens])
        owner, symbols = np.repeat(np.arange(len(pre_tokens)), size), np.array(flat, np.int64)
        end = np.cumsum(size)
        long = {i: int(width[self.merge_long(symbols[end[i] - size[i] : end[i]])].sum()) for i in np.flatnonzero(size > LONG).tolist()}
        short = (size <= LONG)[owner]
        symbols, owner = self.merge(symbols[short], owner[short])
        out = np.bincount(owner, width[symbols], len(pre_tokens)).astype(np.int64)
        out[list(long)] = list(long.values())
        return out

    def count_texts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; the library's own normalizer runs first."""
        cut = [_PRE_TOKENS.findall(self.library.normalize(t)) if t else [] for t in texts]
        new = {t for tokens in cut for t in tokens if t not in self.remembered}
        passing = {}
        for part in np.array_split(np.array(list(new), object), len(new) // 50_000 + 1):
            counted = dict(zip(part.tolist(), self.count(part.tolist()).tolist()))
            (self.remembered if len(self.remembered) + len(part) <= REMEMBERED else passing).update(counted)
        if passing:
            return np.array([sum(passing[t] if t in passing else self.remembered[t] for t in tokens) for tokens in cut], np.int64)
        known = self.remembered.__getitem__
        return np.array([sum(map(known, tokens)) for tokens in cut], np.int64)


@cache
def counter(model_file: str) -> PieceCounter:
    """One counter per worker and vocabulary file."""
    return PieceCounter(model_file)


def count_tokens(df: DataFrame, model_file: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit. ``model_file`` must be readable on every executor."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counter(model_file)
        for texts in batches:
            out = [counts.count_texts(list(texts[i : i + 1000])) for i in range(0, len(texts), 1000)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    out = with_result(df, n_bytes=utf8_length(col(df, text_col)), n_tokens=tokens(col(df, text_col)))
    return with_result(out, over_limit=F.col("n_tokens") > limit)
