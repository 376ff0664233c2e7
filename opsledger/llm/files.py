"""Files of the shared folder, as executors' Python reads and writes them, whatever the store."""

from __future__ import annotations

from typing import Any

from pyarrow import fs


def opened(path: str) -> tuple[Any, str]:
    """(file system, path in it) of a Hadoop-style path."""
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name of this partition and task attempt alone, so that retries and twin tasks never share a file."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId():08d}{suffix}"
