"""Files of records in the shared folder, written by tasks and found through a manifest.

Each attempt of a task writes files of its own name; the manifest, a table that Spark commits, names those that count.
A lost or repeated attempt leaves at most files that no manifest names.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def create(folder: str, name: str) -> tuple[pa.NativeFile, str]:
    """An output stream to a new file of the folder, and the file's address."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None), uri


def reader(uri: str) -> pa.NativeFile:
    """A file to seek in."""
    system, path = filesystem(uri)
    return system.open_input_file(path)


def stream(uri: str, buffer: int = 1 << 20) -> pa.NativeFile:
    system, path = filesystem(uri)
    return system.open_input_stream(path, compression=None, buffer_size=buffer)
