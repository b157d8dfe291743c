"""The folder that driver and executors share, and what is written there for a while."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_UNDO: list[list[Callable[[], None]]] = []


@functools.cache
def _own(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tessera-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder (tests); a cluster must set one,
    because its executors don't share their temporary folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or _own(spark.sparkContext.applicationId)).rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; inside of ``scratch`` it is deleted in the end."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    undo_later(lambda: removed(spark, path))
    return path


def undo_later(undo: Callable[[], None]) -> None:
    """Have ``undo`` called at the end of the innermost ``scratch``, if there is one."""
    if _UNDO:
        _UNDO[-1].append(undo)


@contextmanager
def scratch() -> Iterator[None]:
    """Around a query and the writing of its result: intermediate tables that arise inside are deleted at the end."""
    _UNDO.append([])
    try:
        yield
    finally:
        for undo in reversed(_UNDO.pop()):
            undo()
