"""Shared folders as tasks see them: pyarrow file systems by URI."""

from __future__ import annotations

import os

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by URI or absolute path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(name, bytes) of a folder's files that end in ``suffix``, by name."""
    files, path = open_folder(uri)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))
