"""URL filter: allow and block rules by host and path, and logistic regression for the rest.

The model is a logistic regression on hashed character n-grams of host and path
(3 to 5 bytes, hashed into 2**16 weights), trained on the driver from a small
labelled URL table of at most ``max_rows`` rows. Scoring is one Arrow pass without
a shuffle; the only thing sent to the tasks is the weight vector (512 KB).

Defined results. A null URL, or one without ``://``, has an empty host and path,
fits no rule and is scored by the model's bias. Repeated URLs get equal results.
An empty table gives an empty result; a training table without rows of both labels
gives a model that allows everything its bias allows. Result columns replace input
columns of the same name; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .columns import LOWER, UPPER, col, with_result

SIZES = (3, 4, 5)
DIMENSIONS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path-prefix``; it fits the host and all its subdomains."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_probability(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        owner, index, value = features(hosts, paths)
        z = self.bias + np.bincount(owner, self.weights[index] * value, len(hosts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; ties go to the smaller text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed n-gram, value); a row's values have the square sum 1."""
    owners, indexes = [], []
    for part, texts in enumerate((hosts, paths)):
        buf, starts = H.flatten([b"^" + t.encode("utf-8", "replace") + b"$" for t in texts])
        sums = H.prefix_sums(H.BYTE_VALUES[buf])
        for n in SIZES:
            grams = H.window_hash(sums, n)
            row = np.searchsorted(starts, np.arange(len(grams)), "right") - 1
            whole = np.arange(len(grams)) + n < starts[row + 1]
            owners.append(row[whole])
            indexes.append(((grams[whole] + np.uint64(part * 8 + n)) % np.uint64(DIMENSIONS)).astype(np.int64))
    owner, index = np.concatenate(owners), np.concatenate(indexes)
    count = np.bincount(owner, minlength=len(hosts))
    return owner, index, 1 / np.sqrt(np.maximum(count, 1))[owner]


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_rows: int = 4000,
          rounds: int = 150, rate: float = 0.5, decay: float = 1e-4, share: float = 0.3) -> UrlModel:
    """Fit on a labelled table; label 1 is block. ``share`` is what block weighs of both labels: what nothing is known of is allowed. Of more than ``max_rows`` rows, those first by URL hash are taken."""
    rows = (labelled.select(col(labelled, url_col).alias("u"), col(labelled, label_col).cast("int").alias("y"))
            .where("u IS NOT NULL AND y IS NOT NULL").distinct()
            .select(host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"), "y", "u")
            .orderBy(F.xxhash64("u"), "u", "y").limit(max_rows).collect())
    y = np.array([float(r.y) for r in rows])
    if not len(y) or y.min() == y.max():
        return UrlModel(np.zeros(DIMENSIONS), -1.0 if not len(y) or not y[0] else 1.0)
    owner, index, value = features([r.h for r in rows], [r.p for r in rows])
    w, bias = np.zeros(DIMENSIONS), 0.0
    seen, seen_bias = np.full(DIMENSIONS, 1e-8), 1e-8
    # However many rows each label has.
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, w[index] * value, len(y)), -30, 30)))
        error = (p - y) * weight
        slope = np.bincount(index, error[owner] * value, DIMENSIONS) + decay * w
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    return UrlModel(w, float(bias))


def judge_urls(df: DataFrame, rules: list[Rule], model: UrlModel, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, block_probability and verdict (``allow`` or ``block``)."""

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(model.block_probability(list(hosts), list(paths)))

    host, path = host_of(col(df, url_col)), path_of(col(df, url_col))
    out = with_result(df, host=host, path=path)
    out = with_result(out, block_probability=probability("host", "path"))
    found = longest_rule(F.col("host"), F.col("path"), rules)
    return with_result(out, rule=found["rule"], verdict=F.coalesce(
        found["verdict"], F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")))
