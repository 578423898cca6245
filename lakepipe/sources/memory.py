"""Frames from data in the driver's memory."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema


def from_arrow(spark: SparkSession, table: pa.Table, n_partitions: int = 1) -> DataFrame:
    """Naive timestamps stay naive; rows are dealt to ``n_partitions``."""
    schema = from_arrow_schema(table.schema, prefer_timestamp_ntz=True)
    df = spark.createDataFrame(table, schema) if table.num_rows else spark.createDataFrame([], schema)
    return df.repartition(n_partitions) if n_partitions > 1 else df.coalesce(1)


def from_pandas(spark: SparkSession, pdf, n_partitions: int = 1) -> DataFrame:
    return from_arrow(spark, pa.Table.from_pandas(pdf, preserve_index=False), n_partitions)
