"""Memory of Python workers, which Spark reuses for later stages."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_MMAP_THRESHOLD = -3  # its number in the GNU C library


def trim() -> None:
    """Give freed memory back to the system, so that a worker does not carry one stage's scratch into the next.

    From then on arrays of 4 MB and more have pages of their own, which go back when they are freed; the
    library would otherwise raise that size with every such array.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        library = ctypes.CDLL(None)
        library.mallopt(_MMAP_THRESHOLD, 4 << 20)
        library.malloc_trim(0)
    except (AttributeError, OSError):
        # Only the GNU C library has it; elsewhere freed memory stays with the worker.
        return
