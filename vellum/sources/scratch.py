"""Folders for tables that live as long as a query needs them."""

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders that were handed out and not removed yet, by the scope (see scope()) they were handed out in; the first list is of no scope.
_made: list[list[str]] = [[]]
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which driver and executors share.

    Only a session on one machine (master local[...]), as in tests, may name none; a folder of the machine then serves. Anywhere else it would be a
    different folder on every executor, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/vellum-checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends at files that outlive any executor."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the table that stored() gave as df."""
    path = _paths.pop(df)
    for paths in _made:
        if path in paths:
            paths.remove(path)
    remove(df.sparkSession, [path])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders, in whatever file system they lie; nothing may read them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was stored inside it. What leaves it has to be stored by keep_out(), or be no DataFrame."""
    _made.append([])
    try:
        yield
    finally:
        remove(spark, _made.pop())


def keep_out(df: DataFrame, name: str) -> DataFrame:
    """df stored as a table of the scope around the present one."""
    out = stored(df, name)
    if len(_made) > 1:
        _made[-2].append(_made[-1].pop())
    return out


def clear(spark: SparkSession) -> None:
    """Removes every table that is left; DataFrames that read one cannot be used any more."""
    for paths in _made:
        remove(spark, paths)
        paths.clear()
