"""File scans. Paths, globs and schemes go to Spark, so what Spark can open can be read, and filters and columns reach the scan."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What a path without a scheme means on a filesystem that is given by name.
SCHEMES = {"s3": "s3a", "s3a": "s3a", "gs": "gs", "gcs": "gs", "az": "abfss", "abfs": "abfs", "abfss": "abfss", "file": "file", "hdfs": "hdfs"}


class ConnectorMissing(RuntimeError):
    """A Spark connector that is not on the class path."""


def uri(path: str, filesystem: str | None = None) -> str:
    """``path`` with the scheme that Spark uses for ``filesystem`` (or for the path's own scheme)."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://(.*)", path, re.DOTALL)
    if found:
        return f"{SCHEMES.get(found[1], found[1])}://{found[2]}"
    if filesystem in (None, "", "local"):
        return path
    return f"{SCHEMES.get(filesystem, filesystem)}://{path if filesystem != 'file' else '/' + path.lstrip('/')}"


def _paths(path, filesystem) -> list[str]:
    return [uri(str(p), filesystem) for p in (path if isinstance(path, (list, tuple)) else [path])]


def _children(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at) or []
    return fs, list(found)


def _layout(spark: SparkSession, paths: list[str], suffix: str) -> dict:
    """Nested folders that are not ``key=value`` are read recursively; Spark finds the others by itself."""
    nested = hive = files = False
    for p in paths:
        fs, found = _children(spark, p)
        if not found:
            raise ValueError(f"no {suffix} files found at {p}")
        for status in found:
            if not status.isDirectory():
                files = True
                continue
            if "=" in status.getPath().getName():
                hive = True
            for child in fs.listStatus(status.getPath()):
                name = child.getPath().getName()
                if name.startswith(("_", ".")):
                    continue
                if child.isDirectory():
                    hive, nested = hive or "=" in name, nested or "=" not in name
                else:
                    files = True
    if not (files or nested or hive):
        raise ValueError(f"no {suffix} files found at {', '.join(paths)}")
    if nested and hive:
        raise ValueError(f"key=value folders and other folders side by side at {', '.join(paths)}; read them one by one")
    return {"recursiveFileLookup": "true"} if nested and not hive else {}


def _load(spark: SparkSession, reader, form: str, paths: list[str]) -> DataFrame:
    try:
        return reader.format(form).load(paths)
    except AnalysisException as e:
        if re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA", str(e)):
            raise ValueError(f"no {form} files found at {', '.join(paths)}") from e
        raise


def _dealt(df: DataFrame, n_partitions: int | None) -> DataFrame:
    return df.repartition(n_partitions) if n_partitions else df


def read_parquet(spark: SparkSession, path, n_partitions: int | None = None, filesystem: str | None = None, schema: T.StructType | str | None = None, merge_schema: bool = False) -> DataFrame:
    """A file, a folder, a glob or a list of them; each file once. ``key=value`` folders become columns and are pruned by filters."""
    paths = _paths(path, filesystem)
    reader = spark.read.options(**_layout(spark, paths, "parquet"))
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return _dealt(_load(spark, reader, "parquet", paths), n_partitions)


def read_csv(spark: SparkSession, path, n_partitions: int | None = None, filesystem: str | None = None, delimiter: str = ",", has_header: bool = True, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """As read_parquet. Types are inferred by one more pass unless ``schema`` is given; other options are Spark's."""
    paths = _paths(path, filesystem)
    reader = spark.read.options(sep=delimiter, header=str(has_header).lower(), **_layout(spark, paths, "csv"))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return _dealt(_load(spark, reader, "csv", paths), n_partitions)


def read_files(spark: SparkSession, form: str, path, n_partitions: int | None = None, filesystem: str | None = None, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """As read_parquet, of any file format of Spark's (``json`` objects a line, ``orc``, ``text``, …)."""
    paths = _paths(path, filesystem)
    reader = spark.read.options(**_layout(spark, paths, form), **options)
    if schema is not None:
        reader = reader.schema(schema)
    return _dealt(_load(spark, reader, form, paths), n_partitions)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, n_partitions: int = 8, **properties) -> DataFrame:
    """A table of a database, read in ``n_partitions`` ranges of ``column`` between ``bounds`` (rows outside go to the first and
    last range). Filters and columns reach the database. Needs its driver on the class path."""
    reader = spark.read.options(url=url, dbtable=table, **{k: str(v) for k, v in properties.items()})
    if column is not None:
        if bounds is None:
            raise ValueError("a column to split by needs bounds")
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(n_partitions))
    return _connector(reader, "jdbc", lambda r: r.load())


def schema_of_parquet(spark: SparkSession, path: str, filesystem: str | None = None) -> T.StructType:
    """From the footers; no rows are read."""
    return read_parquet(spark, path, filesystem=filesystem).schema


def _connector(reader, form: str, load) -> DataFrame:
    try:
        return load(reader.format(form))
    except Exception as e:
        if re.search(r"DATA_SOURCE_NOT_FOUND|Failed to find data source|ClassNotFound|No suitable driver", str(e)):
            raise ConnectorMissing(f"Spark's {form} connector is not on the class path; add its package to spark.jars.packages") from e
        raise


def read_delta(spark: SparkSession, path: str, filesystem: str | None = None, version: int | None = None) -> DataFrame:
    """A Delta table, now or as of ``version``; needs the Delta package."""
    reader = spark.read if version is None else spark.read.option("versionAsOf", version)
    return _connector(reader, "delta", lambda r: r.load(uri(path, filesystem)))


def read_kafka(spark: SparkSession, topic: str, bootstrap_servers: str, consumer_config: dict | None = None) -> DataFrame:
    """What a topic holds now; needs Spark's Kafka package."""
    options = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic, "startingOffsets": "earliest", "endingOffsets": "latest"}
    options |= {f"kafka.{k}": str(v) for k, v in (consumer_config or {}).items()}
    return _connector(spark.read.options(**options), "kafka", lambda r: r.load())
