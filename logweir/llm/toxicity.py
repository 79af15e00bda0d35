"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words and their first four to six letters, hashed into 2**20
columns. From a bounded sample of labelled documents the ``terms`` columns whose
document frequency differs most between the labels are kept (their share of the
log-likelihood), and so are pairs of frequent terms that tell more together than both
alone, whatever each does by itself; a document is the set of its kept terms. The machine scores a set by
bias + linear weights + pairwise interactions through ``rank`` factors, so a pair such
as an insult and a group's name can weigh more than both alone, or the other way than both. Training runs on the
driver over at most ``max_rows`` labelled documents, whose terms are found in tasks.

Scoring is one Arrow pass over whole texts without a shuffle.

Defined results. Null and empty texts have no terms and get the score of the bias.
Rows are scored each for itself. With no labelled rows, or only one label, every score
is 0 (or 1, if that label is 1). Result columns replace input columns of the same name;
others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .columns import col, utf8, with_result
from .memory import trim

COLUMNS = 1 << 20
#: Letters of a word, as UTF-8 bytes of lower-cased text: a to z and all beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
PREFIXES = (4, 5, 6)
#: So many frequent terms are tried in pairs; a pair counts from this gain in log-likelihood over both terms (chance reaches
#: it in about one of 10**10 pairs), and at most so many pairs are kept.
FREQUENT, PAIR_GAIN, PAIRS = 1024, 20.0, 500


def term_columns(texts: list[str | None], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, column) of the texts' terms, distinct and sorted; ``used`` marks the columns wanted."""
    raw = [utf8(t.lower()) if t else b"" for t in texts]
    pairs = [np.zeros(0, np.int64)]
    for a, b in H.batches(raw):
        buf, starts = H.flatten(raw[a:b])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], LETTER[buf]))))
        first, last = edge[0::2], edge[1::2]
        owner = np.searchsorted(starts, first, "right") - 1 + a
        sums = H.prefix_sums(H.BYTE_VALUES[buf])
        for end in (last, *(np.minimum(first + n, last) for n in PREFIXES)):
            column = (H.range_hash(sums, first, end) % np.uint64(COLUMNS)).astype(np.int64)
            pair = owner * COLUMNS + column
            pairs.append(np.unique(pair if used is None else pair[used[column]]))
    pair = np.unique(np.concatenate(pairs))
    return pair // COLUMNS, pair % COLUMNS


@dataclass(frozen=True)
class FactorizationMachine:
    columns: np.ndarray  # hashed columns in use, sorted
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # one row per column in use

    def scores(self, texts: list[str | None]) -> np.ndarray:
        used = np.zeros(COLUMNS, bool)
        used[self.columns] = True
        owner, column = term_columns(texts, used)
        index = np.searchsorted(self.columns, column)
        return 1 / (1 + np.exp(-np.clip(margins(owner, index, len(texts), self.bias, self.linear, self.factors)[0], -35, 35)))


def margins(owner, index, n, bias, linear, factors) -> tuple[np.ndarray, np.ndarray]:
    """Log odds by document, and the sums of factors that the gradient needs."""
    sums = np.stack([np.bincount(owner, f[index], n) for f in factors.T], axis=1) if factors.size else np.zeros((n, factors.shape[1]))
    squares = np.bincount(owner, (factors**2).sum(axis=1)[index], n)
    return bias + np.bincount(owner, linear[index], n) + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def train_joined(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 max_rows: int = 12_000, **settings) -> FactorizationMachine:
    """Fit on the documents that ``labels`` names; of more than ``max_rows`` labels, those first by the hash of their id are taken."""
    named = (labels.select(col(labels, id_col).alias("i"), col(labels, label_col).cast("int").alias("y"))
             .where("i IS NOT NULL AND y IS NOT NULL").orderBy(F.xxhash64("i"), "i", "y").limit(max_rows))
    texts = docs.select(col(docs, id_col).alias("i"), col(docs, text_col).alias("t"))
    # At most ``max_rows`` rows are broadcast; the texts stay where they are.
    return train(texts.join(F.broadcast(named), "i").select("i", "t", "y"), "t", "y", "i", max_rows=max_rows, **settings)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = 12_000,
          terms: int = 6000, rank: int = 4, rounds: int = 200, rate: float = 0.2, decay: float = 2e-4) -> FactorizationMachine:
    """Fit on labelled texts; of more than ``max_rows`` rows, those first by the hash of id and label are taken."""

    @F.pandas_udf("array<int>")
    def terms_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            owner, column = term_columns(list(texts))
            yield pd.Series(np.split(column.astype(np.int32), np.searchsorted(owner, np.arange(1, len(texts))))[: len(texts)])

    rows = labelled.select(F.xxhash64(col(labelled, id_col), col(labelled, label_col)).alias("h"), col(labelled, text_col).alias("t"),
                           col(labelled, label_col).cast("int").alias("y")).where("y IS NOT NULL")
    sample = rows.select("h", "y", terms_of("t").alias("x")).orderBy("h", "y", "x").limit(max_rows).toArrow()
    none = np.zeros(0)
    if not sample.num_rows:
        return FactorizationMachine(none.astype(np.int64), -35.0, none, np.zeros((0, rank)))
    y = sample.column("y").to_numpy().astype(float)
    lists = sample.column("x").combine_chunks()
    del sample
    owner = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy())
    flat = lists.flatten().to_numpy()
    if y.min() == y.max():
        return FactorizationMachine(none.astype(np.int64), 35.0 if y[0] else -35.0, none, np.zeros((0, rank)))
    paired = paired_columns(owner, flat, y)
    columns = np.union1d(telling_columns(owner, flat, y, terms), paired)
    used = np.zeros(COLUMNS, bool)
    used[columns] = True
    here = used[flat]
    owner, index = owner[here], np.searchsorted(columns, flat[here])
    # Factors of screened pairs have to grow from nothing to what their linear weights cannot say.
    pace = np.where(np.isin(columns, paired), 0.5, 0.05)[:, None] * rate
    del lists, flat, here
    # The sample's terms are some 100 MB, of which the kept ones are a small part.
    trim()
    n, k = len(y), len(columns)
    linear, factors = np.zeros(k), np.random.default_rng(7).normal(0, 0.02, (k, rank))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    seen, seen_f, seen_b = np.full(k, 1e-8), np.full((k, rank), 1e-8), 1e-8
    for _ in range(rounds):
        z, sums = margins(owner, index, n, bias, linear, factors)
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * weight
        e = error[owner]
        slope = np.bincount(index, e, k)
        slope_f = np.stack([np.bincount(index, e * sums[owner, j], k) for j in range(rank)], axis=1) - factors * slope[:, None] + decay * factors
        slope = slope + decay * linear / k
        seen, seen_f, seen_b = seen + slope**2, seen_f + slope_f**2, seen_b + error.sum() ** 2
        linear = linear - rate * slope / np.sqrt(seen)
        factors = factors - pace * slope_f / np.sqrt(seen_f)
        bias -= rate * error.sum() / np.sqrt(seen_b)
    del owner, index
    trim()
    return FactorizationMachine(columns, float(bias), linear, factors)


def _gain(k: np.ndarray, n: float, share: np.ndarray) -> np.ndarray:
    """What k of n documents say against their expected share, in nats."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(k > 0, k * np.log(k / np.maximum(n * share, 1e-12)), 0)


def _held(flat: np.ndarray, owner: np.ndarray | None = None, chosen: np.ndarray | None = None, step: int = 1 << 20) -> np.ndarray:
    """Documents by column, of the ``chosen`` ones if given; counted in pieces, as numpy makes 64-bit copies of what it counts."""
    out = np.zeros(COLUMNS, np.int64)
    for a in range(0, len(flat), step):
        some = flat[a : a + step]
        out += np.bincount(some if chosen is None else some[chosen[owner[a : a + step]]], minlength=COLUMNS)
    return out


def telling_columns(owner: np.ndarray, flat: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """The columns in which the labels differ most (likelihood-ratio statistic), at least in 3 documents each."""
    n1, n0 = y.sum(), len(y) - y.sum()
    both = _held(flat).astype(float)
    a = _held(flat, owner, y > 0).astype(float)
    some = np.flatnonzero(both >= 3)
    a, b = a[some], both[some] - a[some]
    share = (a + b) / len(y)
    gain = _gain(a, n1, share) + _gain(n1 - a, n1, 1 - share) + _gain(b, n0, share) + _gain(n0 - b, n0, 1 - share)
    # Chance differences carry no information: 6.6 is the 0.1 % point of the statistic's half.
    best = np.argsort(-gain, kind="stable")[:terms]
    return np.sort(some[best[gain[best] > 6.6]])


def paired_columns(owner: np.ndarray, flat: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns of the frequent terms' pairs that say more about the label together than both say alone."""
    n, n1 = len(y), y.sum()
    held = _held(flat)
    # A term in almost every document says as little as one in almost none.
    frequent = np.sort(np.argsort(-np.minimum(held, n - held), kind="stable")[:FREQUENT])
    frequent = frequent[np.minimum(held, n - held)[frequent] >= 5]
    k = len(frequent)
    if k < 2:
        return frequent[:0]
    place = np.full(COLUMNS, -1, np.int32)
    place[frequent] = np.arange(k)
    here = place[flat] >= 0
    rows, at = owner[here], place[flat[here]]
    together = np.zeros((2, k, k), np.float32)
    for first in range(0, n, 1000):
        a, b = np.searchsorted(rows, [first, first + 1000])
        x = np.zeros((min(1000, n - first), k), np.float32)
        x[rows[a:b] - first, at[a:b]] = 1
        label = y[first : first + 1000] > 0
        together[1] += x[label].T @ x[label]
        together[0] += x[~label].T @ x[~label]
    alone = [np.diagonal(t).astype(float) for t in together]
    total, share = alone[0] + alone[1], n1 / n
    single = sum(_gain(c, m, p) for m, p, c in ((total, 1 - share, alone[0]), (total, share, alone[1]),
                                                  (n - total, 1 - share, n - n1 - alone[0]), (n - total, share, n1 - alone[1])))
    found = []
    for i in range(k - 1):
        js = slice(i + 1, k)
        gain = -single[i] - single[js]
        cells = [(t[i, js].astype(float), c[i], c[js], m) for t, c, m in zip(together, alone, (n - n1, n1))]
        split = [(b, ci - b, cj - b, m - ci - cj + b) for b, ci, cj, m in cells]
        for off, on in zip(*split):
            gain = gain + _gain(off, off + on, 1 - share) + _gain(on, off + on, share)
        found += [(-g, i, i + 1 + j) for j, g in zip(np.flatnonzero(gain > PAIR_GAIN).tolist(), gain[gain > PAIR_GAIN].tolist())]
    best = sorted(found)[:PAIRS]
    return np.unique(frequent[[c for _, i, j in best for c in (i, j)]]) if best else frequent[:0]


def score(df: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= ``threshold``)."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(list(texts)))

    out = with_result(df, score=scored(col(df, text_col)))
    return with_result(out, predicted=(F.col("score") >= threshold).cast("int"))
