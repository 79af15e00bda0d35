"""Corpus preparation: distinct lines, class caps, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import split_at

# --- fixed values ------------------------------------------------------------------
PER_CLASS = 20_000
TEST_SHARE = 0.2
SAMPLE_SIZE = 200


def dedupe_lines(corpus: DataFrame) -> DataFrame:
    """Distinct lines per label."""
    return corpus.dropDuplicates(["label", "line"])


def samples_per_label(corpus: DataFrame) -> DataFrame:
    """Lines per label and the number of labels."""
    counts = corpus.groupBy("label").agg(F.count("*").alias("n"))
    # One row per label.
    return counts.join(F.broadcast(counts.agg(F.count("*").alias("n_labels"))), F.lit(True))


def cap_per_class(corpus: DataFrame, n: int = PER_CLASS, seed: int = 42) -> DataFrame:
    """At most ``n`` lines per label, drawn by a seeded hash order (the same on every run)."""
    return _by_hash(corpus, str(n), seed).filter("first").drop("first")


def sample_per_label(corpus: DataFrame, n: int = SAMPLE_SIZE, seed: int = 0) -> DataFrame:
    """A random sample of at most ``n`` lines per label."""
    return cap_per_class(corpus, n, seed)


def stratified_split(corpus: DataFrame, test: float = TEST_SHARE, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the same share of every label goes to the test part."""
    return (_by_hash(corpus, f"cast(round(total * {test}) AS BIGINT)", seed)
            .withColumnRenamed("first", "is_test"))


def _by_hash(corpus: DataFrame, limit: str, seed: int) -> DataFrame:
    hashed = corpus.withColumn("_hash", F.expr(f"sha2(concat('{seed}:', line), 256)"))
    return split_at(hashed, "label", "_hash", limit).drop("_hash")
