"""File writers. Every call adds files; none is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_cols=None, n_partitions: int | None = None) -> None:
    """One file a partition; with ``partition_cols`` ``key=value`` folders, nulls included.

    Rows are brought together by folder first, so folders are not written by every task; Spark splits a folder
    that holds much more than the others (a rebalance, not a plain hash).
    """
    writer_input = df
    if partition_cols:
        cols = [F.col(c) for c in partition_cols]
        writer_input = df.repartition(n_partitions, *cols) if n_partitions else df.hint("rebalance", *cols)
    elif n_partitions:
        writer_input = df.repartition(n_partitions)
    writer = writer_input.write.mode("append").option("compression", compression)
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", include_header: bool = True) -> None:
    df.write.mode("append").options(sep=delimiter, header=str(include_header).lower()).csv(path)


def write_files(df: DataFrame, form: str, path: str, partition_cols=None, **options) -> None:
    """In any format of Spark's; folders as write_parquet makes them."""
    cols = list(partition_cols or [])
    writer = (df.hint("rebalance", *[F.col(c) for c in cols]) if cols else df).write.mode("append").format(form).options(**options)
    (writer.partitionBy(*cols) if cols else writer).save(path)
