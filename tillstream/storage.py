"""Folders that every executor can reach."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, or None where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else None


#: Run folders that have not been removed, by application.
_made: dict[str, list[str]] = {}
#: Those that the step at hand has made, if it removes them at its end.
_own: ContextVar[list[str] | None] = ContextVar("_own", default=None)


def run_folder(spark: SparkSession) -> str:
    """A new folder name for the tables of one run, in the shared folder.

    Only a local session without that setting gets a temporary folder of this machine.
    """
    folder = shared_folder(spark)
    if folder is None:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    made = f"{folder}/tillstream-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(made)
    if (own := _own.get()) is not None:
        own.append(made)
    return made


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Run folders that are made in this context, by this thread, go when it ends.

    For a step whose result has been written elsewhere by then.
    """
    token = _own.set([])
    try:
        yield
    finally:
        own = _own.get() or []
        _own.reset(token)
        made = _made.get(spark.sparkContext.applicationId, [])
        for folder in own:
            if folder in made:
                made.remove(folder)
                _remove(spark, folder)


def remove_run_folders(spark: SparkSession) -> int:
    """Remove what the runs of this session have written so far, and say how many folders there were.

    For a caller who has read all results: a DataFrame that reads such a folder cannot be used any more.
    """
    made = _made.pop(spark.sparkContext.applicationId, [])
    for folder in made:
        _remove(spark, folder)
    return len(made)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder another name; a folder that is not there becomes an empty one."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(name) for name in (source, target))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(old):
        files.mkdirs(new)
        return
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"{source} could not be moved to {target}")


def checked_place(spark: SparkSession, place: str, what: str) -> str:
    """The place itself, unless executors of a cluster could not all find it.

    A relative path is taken in the default file system. Where that is each machine's own, it is refused.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if not _local(spark) and not path.isAbsolute():
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if default.startswith("file:"):
            raise ValueError(f"{what} is the relative path {place!r}: give a folder that all executors share")
    return place


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")
