"""All registered queries."""

from __future__ import annotations

from . import coercion_queries, extraction, io_queries, model_queries, record_queries, run_queries
from .flagship import FLAGSHIP_SQL, flagship
from .query import Query


def extraction_queries() -> list[Query]:
    keys = {"cisco_asa": "extract_firewall_asa", "snort_alert": "extract_ids_snort", "syslog": "extract_syslog5424"}
    out = [Query(keys.get(n, f"extract_{n}"), extraction.extraction_query(n), extraction.extraction_oracle(n))
           for n in extraction.EXPECTED]
    out.append(Query("parse_failures", extraction.failures_query, extraction.failures_oracle()))
    return out


def all_queries() -> dict[str, Query]:
    every = [Query("flagship", flagship, FLAGSHIP_SQL), *extraction_queries(), *coercion_queries.QUERIES,
             *record_queries.QUERIES, *model_queries.QUERIES, *io_queries.QUERIES, *run_queries.QUERIES]
    return {q.name: q for q in every}
