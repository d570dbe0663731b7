"""Whole files written by tasks."""

from __future__ import annotations

import os
import uuid


def put_bytes(uri: str, data: bytes) -> None:
    """Write a file under a name of its own and rename it, so that a repeated task does
    no harm."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        fsys, path = fs.LocalFileSystem(), os.path.abspath("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)
    else:
        fsys, path = fs.FileSystem.from_uri(uri)
    fsys.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fsys.open_output_stream(tmp, compression=None) as out:
        out.write(data)
    fsys.move(tmp, path)
