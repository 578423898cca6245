"""What the operators share: the folder that all machines see, tables written to it, and words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that ends words: space, tab, line feed, vertical tab, form feed, carriage return.
#: It is what bytes.split() splits at, and what this class says in Java's patterns.
BLANK = r"[\x20\x09-\x0D]"

#: Rows that go to a Python worker at a time.
BATCH_ROWS = 1024

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; it goes when the application's Python ends.

    Where that is unset, one machine (a local master) gets a temporary folder; on a cluster that is an error, as executors
    would not see it.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base.rstrip("/") if base else tempfile.gettempdir()
        _folders[app] = f"{base}/lakepipe-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and losing an executor loses nothing of it. Shuffle files go
    when the table is written, not when the driver happens to collect its garbage."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"), small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lakepipe_path = path
    return back


@contextmanager
def settings(spark: SparkSession, **values):
    """Spark settings (dots as two underscores) that hold in it."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession):
    """In it, Python gets BATCH_ROWS rows at a time at most: whole texts and what is made of them take memory beside Spark's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    return settings(spark, **{key: str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS)})


#: Bytes of a table that joins of operators which call small_broadcasts() may send to the driver and to all tasks unasked.
BROADCAST_BYTES = 1 << 20


def small_broadcasts(spark: SparkSession):
    """In it, Spark broadcasts sides of BROADCAST_BYTES at most by itself: what a chain of joins over tables that grow with the
    input leaves in the driver's memory is bounded then, whatever the session allows."""
    most = min(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), BROADCAST_BYTES)
    return settings(spark, spark__sql__autoBroadcastJoinThreshold=str(most), spark__sql__adaptive__autoBroadcastJoinThreshold=str(most))


def bloom_joins(spark: SparkSession):
    """In it, Spark filters the large side of a join by a Bloom filter of the other's keys (of 8 MB at most) before it shuffles.

    The other side must be a table of written() with a comparison on its key (any; Spark wants a filter there to do so)."""
    return settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # at the end of the application Spark may be gone already
        if path.startswith(("/", "file:/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lakepipe_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``docs``."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def identified(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names, which tell documents apart and order them: the id, then a hash of the text.

    Ids that are no integers are ordered as text. Rows without an id come last, by that hash.
    """
    kind = docs.schema[doc_id].dataType
    if isinstance(kind, T.IntegralType):
        key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(2**63 - 1))
    else:
        key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("\U0010ffff"))
    names = free(docs, "__key", "__th")
    return docs.withColumns({names[0]: key, names[1]: F.xxhash64(F.col(f"`{text}`"))}), *names


def small(spark: SparkSession, rows: list, schema: str, most: int = 100_000) -> DataFrame:
    """A frame of rows that the driver holds, to be broadcast in joins while there are no more than ``most``."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def payloads(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column, without making strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


@F.arrow_udf(T.LongType())
def _word_count(text: pa.Array) -> pa.Array:
    return pa.array([0 if b is None else len(b.split()) for b in payloads(text)], pa.int64())


def word_count(text: Column | str) -> Column:
    """Number of words (runs of what is not BLANK); 0 for null."""
    return _word_count(text)


def range_buckets(df: DataFrame, key: Column, n: int) -> Column:
    """The number (0 to n - 1, in order) of the range of about equally many rows that ``key`` (a long) falls into.

    One narrow scan finds the ``n - 1`` bounds. Null keys fall into range 0.
    """
    import numpy as np

    found = df.select(key.alias("k")).where("k IS NOT NULL").agg(F.percentile_approx("k", [(i + 1) / n for i in range(n - 1)] or [0.5], F.lit(max(10_000, 20 * n))).alias("p")).first()["p"]
    bounds = np.array(found if found and n > 1 else [], dtype=np.int64)

    @F.arrow_udf("int")
    def bucket(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, k.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    return bucket(key)
