"""Files in the shared folder, by URI, from driver and executors alike."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def remove_dir(uri: str) -> None:
    system, path = opened(uri)
    try:
        system.delete_dir(path)
    except OSError:
        pass  # gone already


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)


def attempt_name() -> str:
    """A name no other attempt of any task of this stage has."""
    from pyspark import TaskContext

    task = TaskContext.get()
    if task is None:
        return "p00000-a0"
    return f"p{task.partitionId():05d}-a{task.taskAttemptId()}"
