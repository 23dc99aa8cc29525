"""Binary files in the shared folder, for tasks: any store that pyarrow reaches by URI."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def create(folder: str, stem: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A new file named after this task's attempt, so a repeated task never meets its own remains."""
    task = TaskContext.get()
    attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "local"
    uri = f"{folder}/{stem}-{attempt}{suffix}"
    store, path = _at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, store.open_output_stream(path, compression=None)


def open_input(uri: str) -> pa.NativeFile:
    """A file for random reads."""
    store, path = _at(uri)
    return store.open_input_file(path)
