"""Log sources: definitions, extraction jobs, scans and sinks."""

from . import cisco_asa, proxy_access, snort_alert, syslog, web_access, zeek
from .custom import custom_source
from .json_lines import flatten_json
from .samples import SAMPLES
from .spec import SourceSpec, extract, source_specs

SOURCES: dict[str, SourceSpec] = {
    s.name: s.with_changes(samples=SAMPLES[s.name]) for s in (cisco_asa.SPEC, proxy_access.SPEC, snort_alert.SPEC, syslog.SPEC,
                        web_access.SPEC, zeek.CONN, zeek.DNS, zeek.HTTP)
}

# --- fixed values: labels the classifier knows; one of them has no source -----------
LABELS = tuple(sorted([*SOURCES, "miscellaneous"]))

__all__ = ["LABELS", "SOURCES", "SourceSpec", "custom_source", "extract", "flatten_json", "source_specs"]
