"""Raw files in the shared folder, written and read by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file such as ``file:/x``, ``hdfs://n/x``, ``s3://b/x`` or ``/x``."""
    if uri.startswith("file:"):
        uri = "/" + uri.split(":", 1)[1].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, prefix: str, suffix: str):
    """Stream into a file whose name no other task attempt uses; yields the stream and the file's URI.

    Only what a successful attempt returns to Spark names a file, so what a
    lost or repeated attempt leaves is never read.
    """
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield out, f"{folder}/{name}"


def opened(uri: str):
    store, path = filesystem(uri)
    return store.open_input_stream(path, compression=None)


def opened_at(uri: str, offset: int):
    store, path = filesystem(uri)
    source = store.open_input_file(path)
    source.seek(offset)
    return source


def removed(uri: str) -> None:
    store, path = filesystem(uri)
    store.delete_dir(path)
