"""Files of tasks in the shared folder.

A task attempt writes under a name of its own and returns the name as a row; once those rows are checkpointed, the files of
one attempt for each partition are the ones that count, whatever was tried again. The folder may be any that
``pyarrow.fs`` opens by URI: local or network paths, HDFS, object stores.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, ending: str) -> str:
    """URI of a file that no other attempt writes, in an existing or new ``folder``."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/part-{partition():05d}-{uuid.uuid4().hex}{ending}"


def partition() -> int:
    """Index of the partition that this task computes."""
    context = TaskContext.get()
    return context.partitionId() if context else 0
