"""Files in the shared folder from Python, on whatever store its address names."""

from __future__ import annotations

import contextlib

import pyarrow.fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it; a path without a scheme is a local one."""
    if "://" in path or path.startswith("file:/"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@contextlib.contextmanager
def replacing(path: str, attempt: str):
    """An output stream whose file appears under its name when it is whole.

    Each attempt of a task writes a file of its own; the last rename wins, and all
    attempts write the same bytes.
    """
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{attempt}.part"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, at)


def reader(path: str):
    """A source for Arrow: mapped memory for local files, so that slices copy nothing."""
    import pyarrow as pa

    fs, at = filesystem(path)
    return pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)


def attempt() -> tuple[int, str]:
    """The partition's number, and a name for this attempt at it."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return t.partitionId(), f"{t.stageId()}-{t.taskAttemptId()}"
