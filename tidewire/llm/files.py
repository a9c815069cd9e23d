"""Files that tasks write and read in shared storage, whatever its scheme."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def create(folder: str, suffix: str):
    """A new output stream in ``folder`` and its URI.

    The name is unique, so a task that runs twice writes two files; those that a committed index names are the data.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None), uri


def open_for_reading(uri: str):
    """A seekable input file."""
    store, path = _at(uri)
    return store.open_input_file(path)
