"""Binary files in the shared folder, from tasks: local, HDFS or object stores, by the scheme of their address."""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs


def create(uri: str) -> BinaryIO:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_range(uri: str) -> BinaryIO:
    """A seekable file: read_at(size, offset) and size()."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
