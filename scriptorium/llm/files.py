"""Files that tasks write to and read from shared storage.

A task names each file afresh and reports it in a row; Spark's own commit of those
rows decides which files count, so a lost or repeated task leaves at most a file
that no row names.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = resolve(uri)
    system.create_dir(path, recursive=True)


def fresh_name(part: int, seq: int, suffix: str) -> str:
    """A name of its own for each attempt."""
    return f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}{suffix}"
