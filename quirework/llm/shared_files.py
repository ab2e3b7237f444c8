"""Files that tasks write to, and map from, the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_whole(uri: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Write under a name of this attempt and rename it; a task that runs twice leaves one whole file."""
    fs, path = locate(uri)
    folder, _, _ = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    attempt = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as sink:
        write(sink)
    try:
        fs.move(attempt, path)
    except OSError:
        # Some file systems refuse a name that another attempt has taken; its file holds the same.
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(attempt)


def map_file(uri: str) -> pa.NativeFile:
    """Memory-mapped where the shared folder is mounted; else opened for random access."""
    fs, path = locate(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path)
    return fs.open_input_file(path)
