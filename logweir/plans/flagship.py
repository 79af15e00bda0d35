"""The flagship query: lines in, normalized events out, counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extraction import normalized
from .render import WEB


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-access events by outcome, status and event type, with bytes and clients."""
    events = normalized(spark, sf_dir, WEB)
    return events.groupBy(F.col("event.outcome").alias("outcome"), F.col("http.response.status_code").alias("status"),
                          F.array_join("event.type", ",").alias("event_type")).agg(
        F.count("*").alias("n"), F.sum("http.response.body.bytes").alias("bytes"),
        F.countDistinct("source.ip").alias("clients"))


FLAGSHIP_SQL = f"""
SELECT CASE WHEN code < 400 THEN 'success' ELSE 'failure' END AS outcome, CAST(code AS BIGINT) AS status,
  CASE WHEN code = 403 THEN 'access,denied' WHEN code >= 500 THEN 'access,error' ELSE 'access' END AS event_type,
  count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT ip) AS clients
FROM ({WEB.facts_sql()}) WHERE NOT broken GROUP BY 1, 2, 3"""
