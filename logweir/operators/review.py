"""Quarantine review: what should be added or repaired next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.textual import mask_template
from ..sources.sinks import ROWS_PER_FILE
from .ranking import first_per_group, number_all

# --- fixed values of the review report ------------------------------------------
TOP_CLUSTERS = 10
SAMPLES = 2
SAMPLE_LENGTH = 150
MESSAGE_LENGTH = 80


def reason_counts(q: DataFrame) -> DataFrame:
    """Quarantined lines per kind, most common first."""
    return q.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def no_plugin_counts(q: DataFrame) -> DataFrame:
    """Lines whose type is known but has no source, per type, most common first."""
    return (q.filter("kind = 'no_plugin'").groupBy(F.col("detail").alias("log_type"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "log_type"))


def parse_error_groups(q: DataFrame) -> DataFrame:
    """Parse failures per type and message (its first 80 characters), most common first."""
    return (q.filter("kind = 'parse_error'")
            .groupBy("log_type", F.substring("detail", 1, MESSAGE_LENGTH).alias("message"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "log_type", "message"))


def with_template(q: DataFrame) -> DataFrame:
    """The low-confidence lines with their masked template."""
    return q.filter("kind = 'low_confidence'").selectExpr("*", f"{mask_template('raw')} AS template")


def cluster(q: DataFrame) -> DataFrame:
    """Low-confidence lines by template: size and first appearance."""
    return with_template(q).groupBy("template").agg(
        F.count("*").alias("n"), F.min(F.struct("source", "seq")).alias("first"))


def cluster_rank(q: DataFrame, top: int | None = TOP_CLUSTERS) -> DataFrame:
    """Clusters numbered by size, ties by first appearance; the ``top`` ones, or all for None."""
    clusters = cluster(q)
    order = [F.desc("n"), F.col("first")]
    if top is None:
        return number_all(clusters, order)
    best = clusters.orderBy(*order).limit(top)
    # At most ``top`` rows are left to be numbered.
    return best.selectExpr("*", "cast(row_number() OVER (ORDER BY n DESC, first) AS BIGINT) AS rank")


def cluster_samples(q: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first lines of each cluster, cut to 150 characters."""
    return first_per_group(with_template(q), "template", ["source", "seq"], n).selectExpr(
        "template", "cast(rank AS BIGINT) AS rank", f"substring(raw, 1, {SAMPLE_LENGTH}) AS sample")


def parse_error_samples(q: DataFrame, top: int | None = TOP_CLUSTERS, n: int = SAMPLES) -> DataFrame:
    """The ``top`` groups of parse failures (all for None) with their first lines, cut to 150 characters."""
    groups = parse_error_groups(q)
    if top is not None:
        groups = groups.limit(top)
    lines = q.filter("kind = 'parse_error'").select(
        "log_type", F.substring("detail", 1, MESSAGE_LENGTH).alias("message"), "raw", "source", "seq")
    # A group's lines are cut to ``n`` in every task before they are shuffled.
    keyed = lines.withColumn("_group", F.struct("log_type", "message"))
    first = first_per_group(keyed, "_group", ["source", "seq"], n).selectExpr(
        "log_type", "message", "cast(rank AS BIGINT) AS rank", f"substring(raw, 1, {SAMPLE_LENGTH}) AS sample")
    return first.join(groups.withColumnRenamed("n", "group_size"), ["log_type", "message"])


def export_clusters(q: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the raw lines of every cluster to ``<path>/cluster=<number>/`` as text.

    A cluster's size says how many tasks write it: its lines are dealt over that many
    shares by the hash of their place, so a dominant one is not gathered by the writer. In the join before, a
    template with a large share of the lines is split by the skew-join rule.
    """
    ranked = cluster_rank(q, None).selectExpr("template", "rank AS cluster", f"cast(ceil(n / {rows_per_file}) AS INT) AS shares")
    lines = with_template(q).selectExpr("template", "raw AS value", "xxhash64(source, seq) AS _spread")
    placed = lines.join(ranked, "template").selectExpr("cluster", "value", "cast(pmod(_spread, shares) AS INT) AS _share")
    placed.repartition("cluster", "_share").drop("_share").write.mode("overwrite").partitionBy("cluster").text(path)
