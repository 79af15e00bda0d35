"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

A document is contaminated by an item when some stretch of it is within
``max_ratio`` (10 %) of the item's length in edit distance, both lower-cased and with
white space runs as one space.

1. Windows. An edit touches ``q`` grams, so a stretch with at most k edits keeps at least
   m - q + 1 - q k of the grams of an item of m characters. ``q`` is at most m / (k + 1) in
   every length class (and at most ``Q``), so at least one is left at the full 10 %, wherever
   the edits stand. A gram at place j of an item and p of the text puts the item's start at
   p - j; in such a stretch these starts differ by at most k. Windows start there, at any
   character, where enough grams of the same item agree. Nothing within 10 % is passed over.
2. Embedding. The random walk of Chakraborty, Goldenberg and Koucky copies the
   character under a cursor that random bits, by step and character, move on or hold;
   edit distance becomes Hamming distance. Windows walk as far as the items of their
   length class. Each of ``WALKS`` walks has ``TABLES`` hash tables over ``BITS`` sampled
   steps; windows and items that share a key are candidates, and nothing else is one. Of stretches
   at the full 10 % with edits spread evenly, the worst case, some 0.99 share a key, of those at 8 %
   all that were tried, of exact copies all.
3. Verification. A bit-parallel automaton finds the smallest distance between the item
   and any stretch around the window; only distances within the limit count.

All of this is one Arrow pass over whole texts. Items are taken in blocks of at most
``ITEM_BLOCK``, so what is sent to the tasks is bounded; each block is one such pass.

Defined results. Null and empty texts, and items without a word, match nothing.
Repeated rows are judged each for itself; items that share an id count as one item,
by the smaller distance, and so do those without an id, whose item_id is null. An empty table on either side gives no contamination.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .columns import col, free_name
from .memory import trim

MAX_RATIO = 0.1
Q = 8
WALKS, TABLES, BITS = 16, 32, 5
#: Walked characters held at a time, over all walks of a run of windows.
_WALKED = 16 << 20
ITEM_BLOCK = 5000
CLASS_RATIO = 1.25
_SLOTS, _RUNS = 1 << 22, 1 << 18
#: Characters of texts that are searched at a time.
_SEARCHED = 1 << 19
_ENTRIES = 1 << 21
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


def normalize(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def gram_sums(points: np.ndarray) -> np.ndarray:
    """Prefix sums for ``hashing.window_hash``, from which the hashes of all q-grams follow."""
    return H.prefix_sums(_VALUES[points & 0xFFFF])


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(_SLOTS - 1)).astype(np.int64)


def dense(at: np.ndarray, need: int, span: int) -> np.ndarray:
    """Those of the sorted places that are among ``need`` places within ``span``."""
    if len(at) < need:
        return at[:0]
    first = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= span)
    edge = np.bincount(first, minlength=len(at) + 1) - np.bincount(first + need, minlength=len(at) + 1)
    return at[np.cumsum(edge[:-1]) > 0]


def best_stretch(pattern: str, text: str) -> tuple[int, int]:
    """(smallest edit distance between the pattern and any stretch of the text, where that stretch ends)."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, full, top = (1 << m) - 1, 0, m, (1 << m) - 1, 1 << (m - 1)
    best = (m, 0)
    for end, c in enumerate(text, 1):
        x = masks.get(c, 0) | down
        d = (((x & up) + up) ^ up) | x
        h_plus, h_minus = down | ~(d | up), up & d
        if h_plus & top:
            score += 1
        if h_minus & top:
            score -= 1
        h_plus <<= 1  # a stretch may start anywhere: no cost for what stands before it
        up, down = ((h_minus << 1) | ~(d | h_plus)) & full, h_plus & d & full
        if score < best[0]:
            best = (score, end)
    return best


@dataclass
class LengthClass:
    low: int
    high: int
    items: np.ndarray
    steps: int
    q: int
    span: int  # between the first and the last gram of a stretch
    grams: np.ndarray  # sorted hashes of the items' q-grams
    first: np.ndarray  # by gram, where its entries start (one more than grams)
    entries: np.ndarray  # by entry: the item and the place in it
    moves: np.ndarray  # by step, then walk and character: does the cursor move on
    picks: np.ndarray  # by walk and table: the sampled steps
    keys: list[tuple[np.ndarray, np.ndarray]]  # by walk and table: sorted keys, items in that order

    def keys_of(self, points: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The keys of all tables, walk by walk, for the windows at ``starts``."""
        n = len(starts)
        at, out = np.tile(starts.astype(np.int64), WALKS), np.empty((self.steps, WALKS * n), np.uint16)
        last, walk = len(points) - 1, np.repeat(np.arange(WALKS) * 256, n)
        for t in range(self.steps):
            c = points[np.minimum(at, last)]
            out[t] = c
            at += self.moves[t][walk + (c & 255)]
        for w in range(WALKS):
            for pick in self.picks[w]:
                key = np.zeros(n, np.uint64)
                for t in pick:
                    key = key * np.uint64(0x100000001B3) + out[t, w * n : (w + 1) * n]
                yield key.astype(np.uint32)


class ItemIndex:
    """Everything about a block of items that a task needs."""

    def __init__(self, ids: list, texts: list[str | None], max_ratio: float = MAX_RATIO, seed: int = 3):
        kept = [(i, t) for i, t in ((i, normalize(t)) for i, t in zip(ids, texts)) if t]
        self.ids, self.texts, self.max_ratio = [i for i, _ in kept], [t for _, t in kept], max_ratio
        self.marked: dict[int, np.ndarray] = {}  # by q and slot: the length classes, as bits, whose items have a gram there
        rng = np.random.default_rng(seed)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits = (max_ratio * lengths).astype(np.int64)
        self.need = np.zeros(len(lengths), np.int64)  # fewest q-grams of an item in a stretch that can match
        self.classes: list[LengthClass] = []
        left = lengths
        while len(left):
            low = int(left.min())
            high = max(low, int(low * CLASS_RATIO))
            items = np.flatnonzero((lengths >= low) & (lengths <= high))
            left = left[left > high]
            steps = 2 * low
            q = int(min(Q, (lengths[items] // (self.edits[items] + 1)).min()))
            self.need[items] = lengths[items] - q + 1 - q * self.edits[items]
            grams = [H.window_hash(gram_sums(code_points(self.texts[i])), q) for i in items]
            entries = np.stack((np.repeat(items, [len(g) for g in grams]), np.concatenate([np.arange(len(g)) for g in grams])))
            grams = np.concatenate(grams)
            order = np.argsort(grams, kind="stable")
            grams, first = np.unique(grams[order], return_index=True)
            c = LengthClass(low, high, items, steps, q, int((lengths[items] + self.edits[items]).max()) - q, grams, np.append(first, len(order)), entries[:, order],
                            rng.integers(0, 2, (steps, WALKS * 256), dtype=np.uint8), rng.integers(0, steps, (WALKS, TABLES, BITS)), [])
            # Items stand side by side with room behind them, as windows do at a text's end.
            room = "\x00" * (steps + 1)
            points = code_points("".join(self.texts[i] + room for i in items))
            starts = np.cumsum([0, *(len(self.texts[i]) + len(room) for i in items[:-1])])
            for key in c.keys_of(points, starts):
                order = np.argsort(key, kind="stable")
                c.keys.append((key[order], items[order].astype(np.int32)))
            self.classes.append(c)

        self._mark()

    def _mark(self) -> None:
        for number, c in enumerate(self.classes):
            self.marked.setdefault(c.q, np.zeros(_SLOTS, np.uint32))[slots(c.grams)] |= np.uint32(1 << min(number, 31))

    def __getstate__(self) -> dict:
        # Marks follow from the classes' grams: they do not travel to the tasks.
        return self.__dict__ | {"marked": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._mark()

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text: (item, distance, end of the stretch in the normalized text) of all items it contains."""
        normal = [normalize(t) for t in texts]
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.classes:
            return out
        first, held = 0, 0
        for i, t in enumerate([*normal, None]):
            if t is None or held + len(t) > _SEARCHED:
                if i > first:
                    self._find(normal[first:i], out, first)
                first, held = i, 0
            held += len(t or "")
        return out

    def _find(self, normal: list[str], out: list[list[tuple]], base: int) -> None:
        points = code_points("\n".join([*normal, ""]))
        starts = np.cumsum([0, *(len(t) + 1 for t in normal)])
        sums, padded = gram_sums(points), np.concatenate((points, np.zeros(1, np.uint32)))
        pairs: set[tuple[int, int, int]] = set()
        for q, marked in self.marked.items():
            grams = H.window_hash(sums, q)
            marks = marked[slots(grams)]
            hits = np.flatnonzero(marks)
            marks = marks[hits]
            for number, c in enumerate(self.classes):
                if c.q == q:
                    at = hits[marks >> np.uint32(min(number, 31)) & np.uint32(1) == 1]
                    for doc, item, begin in self.aligned(c, grams, at, starts):
                        places = begin - starts[doc]
                        windows = np.unique(np.stack((doc, places)), axis=1)
                        step = max(1, _WALKED // (c.steps * WALKS))
                        for a in range(0, windows.shape[1], step):
                            docs, place = windows[:, a : a + step]
                            for (keys, items), key in zip(c.keys, c.keys_of(padded, starts[docs] + np.maximum(place, 0))):
                                x, y = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                                for i in np.flatnonzero(y > x).tolist():
                                    pairs.update((int(docs[i]), int(place[i]), int(j)) for j in items[x[i] : y[i]])
        self.verify(normal, sorted(pairs), out, base)

    def aligned(self, c: LengthClass, grams: np.ndarray, at: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, start): where as many of an item's grams as a match must keep agree on its start, within its edits."""
        need, width = int(self.need[c.items].min()), int(self.edits[c.items].max()) + 1
        at = dense(at, need, c.span)
        gram = np.minimum(np.searchsorted(c.grams, grams[at]), len(c.grams) - 1)
        at = dense(at[c.grams[gram] == grams[at]], need, c.span)
        gram = np.searchsorted(c.grams, grams[at])
        count = c.first[gram + 1] - c.first[gram]
        total, a = np.cumsum(count), 0
        while a < len(at):
            # So many entries at a time, but a stretch at least; the next part starts a stretch earlier.
            b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + _ENTRIES)), int(np.searchsorted(at, at[a] + 2 * c.span + 2)))
            n = count[a:b]
            entry = np.repeat(c.first[gram[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, place = c.entries[:, entry]
            p = np.repeat(at[a:b], n)
            begin = p - place
            # Counts by item and run of starts: agreeing starts lie in two neighbouring runs. Others in the same slot only add.
            slot = item * 1000003 + begin // width & _RUNS - 1
            held = np.bincount(slot, minlength=_RUNS)
            some = held[slot] + np.maximum(held[slot - 1], held[slot + 1 & _RUNS - 1]) >= self.need[item]
            item, begin, doc = item[some], begin[some], np.searchsorted(starts, p[some], "right") - 1
            order = np.lexsort((begin, item, doc))
            item, begin, doc = item[order], begin[order], doc[order]
            first = np.arange(len(item))
            last = first + self.need[item] - 1
            first, last = first[last < len(item)], last[last < len(item)]
            first = first[(item[last] == item[first]) & (doc[last] == doc[first]) & (begin[last] - begin[first] <= self.edits[item[first]])]
            yield doc[first], item[first], begin[first]
            if b >= len(at):
                return
            a = int(np.searchsorted(at, at[b] - c.span))

    def verify(self, normal: list[str], pairs: list[tuple[int, int, int]], out: list[list[tuple]], base: int) -> None:
        best: dict[tuple[int, object], tuple[int, int]] = {}
        seen: dict[tuple[int, int], int] = {}
        for doc, place, item in pairs:
            pattern, edits = self.texts[item], int(self.edits[item])
            # A stretch looked at from a window just before is not looked at again.
            if place <= seen.get((doc, item), place - 1) or best.get((doc, self.ids[item]), (1, 0))[0] == 0:
                continue
            # The stretch starts up to ``edits`` before or after the window, and so it does for windows just behind.
            first = max(0, place - edits)
            stretch = normal[doc][first : place + len(pattern) + 3 * edits]
            seen[doc, item] = place + edits
            exact = stretch.find(pattern)
            distance, end = (0, exact + len(pattern)) if exact >= 0 else best_stretch(pattern, stretch)
            key = doc, self.ids[item]
            if distance <= edits and (key not in best or (distance, first + end) < best[key]):
                best[key] = distance, first + end
        for (doc, item), (distance, end) in sorted(best.items(), key=lambda e: (e[0][0], str(e[0][1]))):
            out[base + doc].append((item, distance, end))


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = ITEM_BLOCK) -> Iterator[ItemIndex]:
    """Indexes of at most ``block`` items each; the driver holds one block at a time."""
    rows = items.select(col(items, id_col).cast("long").alias("i"), col(items, text_col).alias("t")).where("t IS NOT NULL").orderBy("i", "t")
    ids, texts = [], []
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        if len(ids) == block:
            yield ItemIndex(ids, texts)
            ids, texts = [], []
    if ids:
        yield ItemIndex(ids, texts)


def leaks(text: Column, index: ItemIndex) -> Column:
    """Array of (item_id, distance, end) of the items a text contains."""

    @F.pandas_udf("array<struct<item_id:long,distance:int,end:long>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in row] for row in index.find(list(texts))], dtype=object)
        trim()

    return found(text)


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end): one row per document and item it contains."""
    docs = df.select(col(df, id_col).alias("doc_id"), col(df, text_col).alias("_text"))
    out = None
    for index in item_blocks(items, item_id, item_text):
        one = docs.select("doc_id", F.explode(leaks(F.col("_text"), index)).alias("_f")).select("doc_id", "_f.item_id", "_f.distance", "_f.end")
        out = one if out is None else out.unionByName(one)
    return docs.select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("item_id", "long"), ("distance", "int"), ("end", "long"))]).limit(0) if out is None else out


def decontaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``df`` without contaminated documents."""
    out, hidden = df, free_name(df, "_leaks")
    for index in item_blocks(items, item_id, item_text):
        out = out.withColumn(hidden, leaks(col(out, text_col), index)).where(F.size(hidden) == 0).drop(hidden)
    return out
