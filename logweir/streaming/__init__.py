"""Structured Streaming entry points."""

from .stream import committed, normalize_batch, read_ledger, stream_counters, stream_lines, stream_normalize, stream_totals

__all__ = ["committed", "normalize_batch", "read_ledger", "stream_counters", "stream_lines", "stream_normalize", "stream_totals"]
