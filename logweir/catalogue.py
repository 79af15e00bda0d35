"""The event schema: field catalogue, vocabularies and code tables.

Everything in this module is a fixed value. The paths follow the Elastic Common
Schema; beside each stands the coercion the normalizer applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: versions -------------------------------------------------
ECS_VERSION = "8.11"
SCHEMA_VERSION = "1.0"
PIPELINE_VERSION = "1.0.0"
DEFAULT_THRESHOLD = 0.60

# --- fixed values: event fields ---------------------------------------------
EVENT_FIELDS: dict[str, str] = {
    "@timestamp": "date",
    "message": "text",
    "tags": "keyword[]",
    "labels": "object",

    "event.original": "text",
    "event.id": "keyword",
    "event.hash": "keyword",
    "event.ingested": "date",
    "event.created": "date",
    "event.kind": "keyword",
    "event.category": "keyword[]",
    "event.type": "keyword[]",
    "event.action": "keyword",
    "event.outcome": "keyword",
    "event.severity": "long",
    "event.module": "keyword",
    "event.dataset": "keyword",
    "event.provider": "keyword",
    "event.code": "keyword",
    "event.reason": "keyword",
    "event.duration": "duration",
    "event.timezone": "keyword",

    "host.name": "keyword",
    "host.hostname": "keyword",
    "host.ip": "ip[]",

    "observer.vendor": "keyword",
    "observer.product": "keyword",
    "observer.type": "keyword",
    "observer.name": "keyword",
    "observer.hostname": "keyword",
    "observer.ingress.zone": "keyword",
    "observer.egress.zone": "keyword",
    "observer.ingress.interface.name": "keyword",
    "observer.egress.interface.name": "keyword",

    "process.name": "keyword",
    "process.pid": "long",

    "user.name": "keyword",
    "user.domain": "keyword",
    "user.effective.name": "keyword",

    "source.ip": "ip",
    "source.port": "long",
    "source.bytes": "long",
    "source.packets": "long",
    "source.domain": "keyword",
    "source.nat.ip": "ip",
    "source.nat.port": "long",
    "source.user.name": "keyword",

    "destination.ip": "ip",
    "destination.port": "long",
    "destination.bytes": "long",
    "destination.packets": "long",
    "destination.domain": "keyword",
    "destination.nat.ip": "ip",
    "destination.nat.port": "long",

    "network.transport": "keyword",
    "network.protocol": "keyword",
    "network.iana_number": "keyword",
    "network.direction": "keyword",
    "network.bytes": "long",
    "network.packets": "long",
    "network.community_id": "keyword",
    "network.type": "keyword",

    "http.request.method": "keyword",
    "http.request.referrer": "keyword",
    "http.request.bytes": "long",
    "http.request.body.bytes": "long",
    "http.response.status_code": "long",
    "http.response.bytes": "long",
    "http.response.body.bytes": "long",
    "http.response.mime_type": "keyword",
    "http.version": "keyword",

    "url.original": "keyword",
    "url.full": "keyword",
    "url.scheme": "keyword",
    "url.domain": "keyword",
    "url.port": "long",
    "url.path": "keyword",
    "url.query": "keyword",

    "user_agent.original": "keyword",

    "dns.id": "keyword",
    "dns.op_code": "keyword",
    "dns.question.name": "keyword",
    "dns.question.type": "keyword",
    "dns.question.class": "keyword",
    "dns.response_code": "keyword",
    "dns.answers": "object[]",
    "dns.resolved_ip": "ip[]",
    "dns.header_flags": "keyword[]",

    "rule.id": "keyword",
    "rule.name": "keyword",
    "rule.category": "keyword",
    "rule.ruleset": "keyword",
    "rule.version": "keyword",

    "log.level": "keyword",
    "log.logger": "keyword",
    "log.file.path": "keyword",
    "log.source.address": "keyword",
    "log.syslog.priority": "long",
    "log.syslog.facility.code": "long",
    "log.syslog.facility.name": "keyword",
    "log.syslog.severity.code": "long",
    "log.syslog.severity.name": "keyword",
    "log.syslog.hostname": "keyword",
    "log.syslog.appname": "keyword",
    "log.syslog.procid": "keyword",
    "log.syslog.msgid": "keyword",
    "log.syslog.version": "long",

    "related.ip": "ip[]",
    "related.user": "keyword[]",
    "related.hosts": "keyword[]",
    "related.hash": "keyword[]",

    "error.type": "keyword",
    "error.message": "text",
    "error.code": "keyword",
}

# --- fixed values: run metadata carried by every record ----------------------
METADATA_FIELDS: dict[str, str] = {
    "pipeline.schema.version": "keyword",
    "pipeline.pipeline.version": "keyword",
    "pipeline.parser.name": "keyword",
    "pipeline.parser.version": "keyword",
    "pipeline.classification.log_type": "keyword",
    "pipeline.classification.confidence": "float",
    "pipeline.classification.candidates": "object[]",
    "pipeline.ingest.source": "keyword",
    "pipeline.ingest.seq": "long",
}

# --- fixed values: controlled vocabularies ------------------------------------
EVENT_KIND = ("alert", "enrichment", "event", "metric", "pipeline_error", "signal", "state")
EVENT_CATEGORY = (
    "authentication", "configuration", "database", "driver", "email", "file", "host", "iam",
    "intrusion_detection", "malware", "network", "package", "process", "registry", "session",
    "threat", "vulnerability", "web",
)
EVENT_TYPE = (
    "access", "admin", "allowed", "change", "connection", "creation", "deletion", "denied", "end",
    "error", "group", "indicator", "info", "installation", "protocol", "start", "user",
)
EVENT_OUTCOME = ("failure", "success", "unknown")

# --- fixed values: fields that feed the cross-source pivots -------------------
RELATED = {
    "related.ip": ("source.ip", "destination.ip", "source.nat.ip", "destination.nat.ip",
                   "host.ip", "dns.resolved_ip"),
    "related.user": ("user.name", "source.user.name", "user.effective.name"),
    "related.hosts": ("host.name", "host.hostname", "observer.hostname", "url.domain",
                      "destination.domain", "source.domain", "dns.question.name"),
}

# --- fixed values: syslog codes (RFC 5424) and the 0-10 severity scale ---------
SYSLOG_SEVERITY_SCALE = {0: 10, 1: 9, 2: 8, 3: 7, 4: 5, 5: 4, 6: 2, 7: 1}
SYSLOG_SEVERITY_NAME = {
    0: "emergency", 1: "alert", 2: "critical", 3: "error", 4: "warning", 5: "notice", 6: "informational", 7: "debug",
}
SYSLOG_FACILITY_NAME = {
    0: "kern", 1: "user", 2: "mail", 3: "daemon", 4: "auth", 5: "syslog", 6: "lpr", 7: "news", 8: "uucp", 9: "cron",
    10: "authpriv", 11: "ftp", 12: "ntp", 13: "security", 14: "console", 15: "solaris-cron", 16: "local0", 17: "local1",
    18: "local2", 19: "local3", 20: "local4", 21: "local5", 22: "local6", 23: "local7",
}

SQL_TYPE = {
    "date": "string", "keyword": "string", "text": "string", "long": "bigint", "float": "double",
    "boolean": "boolean", "duration": "bigint", "ip": "string", "ip[]": "array<string>",
    "keyword[]": "array<string>", "object[]": "array<struct<data:string,ttl:bigint>>",
    "object": "map<string,string>",
}


def field_catalogue(spark: SparkSession) -> DataFrame:
    """One row per schema field: path, type, and whether it is run metadata."""
    rows = [(p, t, False) for p, t in EVENT_FIELDS.items()]
    rows += [(p, t, True) for p, t in METADATA_FIELDS.items()]
    return spark.createDataFrame(rows, "path string, type string, metadata boolean")


def vocabulary(spark: SparkSession) -> DataFrame:
    """The controlled vocabularies as (field, value) rows."""
    words = {"event.kind": EVENT_KIND, "event.category": EVENT_CATEGORY,
             "event.type": EVENT_TYPE, "event.outcome": EVENT_OUTCOME}
    rows = [(field, w) for field, ws in words.items() for w in ws]
    return spark.createDataFrame(rows, "field string, value string")
