"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docengine-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table at a shared_path(), read back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of path, and the path in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


@contextmanager
def held(df: DataFrame, label: str):
    """written(), for the length of a block."""
    path = shared_path(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        system, folder = file_system(df.sparkSession, path)
        system.delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = file_system(spark, path)
    return system.exists(folder)


_SHARED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def shared_tables(spark: SparkSession, labels: tuple[str, ...], folder: str, build: Callable[[], tuple[DataFrame, ...]]) -> list[DataFrame]:
    """What build() gives for the tables in folder, written once an application and read by all that ask for it.

    The tables of a folder are taken not to change meanwhile. A table of
    written() stays where it is.
    """
    keys = [(spark.sparkContext.applicationId, label, folder) for label in labels]
    if not all(key in _SHARED and exists(spark, _SHARED[key][0]) for key in keys):
        for key, df in zip(keys, build()):
            path = _WRITTEN.get(df)
            if path is None:
                path = shared_path(spark, key[1])
                df.write.parquet(path)
            _SHARED[key] = (path, df.schema)
    return [spark.read.schema(schema).parquet(path) for path, schema in map(_SHARED.__getitem__, keys)]


def shared(spark: SparkSession, label: str, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """shared_tables() of one table."""
    return shared_tables(spark, (label,), folder, lambda: (build(),))[0]
