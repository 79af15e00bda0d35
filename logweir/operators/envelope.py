"""Blank-line filter and event envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..catalogue import PIPELINE_VERSION
from ..functions.coerce import iso_millis
from ..functions.sql import text


def drop_blank(df: DataFrame) -> DataFrame:
    """Leave out lines of white space only."""
    return df.filter("raw RLIKE '(?U)\\\\S'")


def envelope(df: DataFrame, received_at: str = "current_timestamp()") -> DataFrame:
    """Stamp lines (``source``, ``seq``, ``raw``) with ids, receipt time and version.

    ``event_id`` names the occurrence, ``event_hash`` the content. ``received_at``
    is a TIMESTAMP expression; all lines of a batch share it.
    """
    return df.selectExpr(
        "*",
        "sha2(concat_ws(':', source, cast(seq AS STRING), raw), 256) AS event_id",
        "sha2(raw, 256) AS event_hash",
        f"{iso_millis(received_at)} AS received_at",
        f"{text(PIPELINE_VERSION)} AS pipeline_version")
