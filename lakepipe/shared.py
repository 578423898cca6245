"""Folders and files that the driver and all executors see, through Hadoop's filesystems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, what: str = "lakepipe") -> str:
    """The name of a new folder below spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of this machine; on a cluster it is an error, as executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _opened(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def make(spark: SparkSession, path: str) -> None:
    fs, at = _opened(spark, path)
    fs.mkdirs(at)


def put(spark: SparkSession, path: str, name: str, data: bytes) -> None:
    """A file of ``path`` that is there as a whole or not at all."""
    fs, at = _opened(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(at, f".{name}")
    out = fs.create(hidden)
    try:
        out.write(data)
    finally:
        out.close()
    fs.rename(hidden, spark._jvm.org.apache.hadoop.fs.Path(at, name))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _opened(spark, path)
    fs.delete(at, True)
