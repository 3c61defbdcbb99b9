"""Intermediate tables in the folder every executor can reach.

A table written here cuts the lineage: losing an executor afterwards costs a
re-read, not a recomputation, and the file sizes tell the planner how large the
table really is before it chooses a join.
"""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, tempfile.TemporaryDirectory] = {}
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # nor local-cluster
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.TemporaryDirectory(prefix="subledger-")
    return _own_folders[app].name


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What this block stages lies in a folder of its own, which goes when the block ends.

    So write results elsewhere before that: tables that read staged ones do not outlive them.
    """
    folder = f"{shared_folder(spark)}/subledger/{uuid.uuid4().hex}"
    before = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(before)
        remove(spark, folder)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch.get() or f'{shared_folder(spark)}/subledger'}/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path on it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever store it lies; none is no error."""
    store, place = _store(spark, path)
    store.delete(place, True)


def replaced(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` beside ``path``, then put it in the place of what was there, and read it.

    A failed write leaves the old table as it was, and ``df`` may read it. Between the two
    renames there is no table for a moment; where the store has no renames, they copy.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, aside = f"{path}.{mark}.new", f"{path}.{mark}.old"
    try:
        df.write.parquet(fresh)
    except BaseException:
        remove(spark, fresh)
        raise
    store, place = _store(spark, path)
    if store.exists(place):
        store.rename(place, _store(spark, aside)[1])
    store.rename(_store(spark, fresh)[1], place)
    remove(spark, aside)
    return spark.read.schema(df.schema).parquet(path)
