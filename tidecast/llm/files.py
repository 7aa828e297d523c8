"""Binary files of tasks in the shared folder, on any file system Arrow can open."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

FILE_BYTES = 256 << 20  # of content; a writer then begins another file
MOST_TASKS = 100_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file://{folder}")


def attempt_name(part: int, ending: str) -> str:
    """A name no other attempt of the task has; only files named in a task's rows count."""
    return f"part-{part:06d}-{uuid.uuid4().hex}{ending}"


def one_a_task(files: DataFrame) -> DataFrame:
    """Rows naming files, dealt to as many tasks as there are files.  Without a number Spark would merge so small a table into one task."""
    n = files.count()
    return files.repartitionByRange(min(max(n, 1), MOST_TASKS), "file")
