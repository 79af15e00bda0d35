"""logweir: mixed raw logs into one typed, lossless event table, on Spark."""

from .session import configure

__version__ = "1.0.0"
__all__ = ["configure"]
