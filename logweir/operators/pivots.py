"""Cross-source pivots on the ``related`` fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_lookup(events: DataFrame, kind: str) -> DataFrame:
    """Events and log types per address, user or host (``kind``: ip, user or hosts)."""
    return (events.select("log_type", F.explode(f"related.{kind}").alias("value"))
            # Counted by type first, so a value seen everywhere is a few rows by the second step.
            .groupBy("value", "log_type").agg(F.count("*").alias("n"))
            .groupBy("value").agg(F.sum("n").alias("n"), F.count("*").alias("n_types"),
                                  F.array_join(F.sort_array(F.collect_list("log_type")), ",").alias("types")))


def events_of(events: DataFrame, kind: str, value: str) -> DataFrame:
    """All events that carry one address, user or host, whatever their source."""
    return events.filter(F.array_contains(f"related.{kind}", value))
