"""How rows are dealt to partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakepipe.operators.ordering import order_columns

PARTITION_ID = "__partition_id"


@dataclass(frozen=True)
class EvenPartitionSpec:
    """Rows dealt round robin. 0 partitions: as many as Spark's default."""

    n_partitions: int = 0


@dataclass(frozen=True)
class HashPartitionSpec:
    """Rows with equal keys together."""

    keys: list[str] = field(default_factory=list)
    n_partitions: int = 0


@dataclass(frozen=True)
class RangePartitionSpec:
    """Ranges of the keys in order (``-key`` for descending), of about as many rows each."""

    keys: list[str] = field(default_factory=list)
    n_partitions: int = 0


@dataclass(frozen=True)
class UserDefinedPartitionSpec:
    """``fn(RecordBatch)`` gives an integer for each row; it counts modulo ``n_partitions``, so no row is lost."""

    fn: Callable
    n_partitions: int = 1


def repartition(df: DataFrame, spec) -> DataFrame:
    if isinstance(spec, EvenPartitionSpec):
        return df.repartition(spec.n_partitions or _default(df))
    if isinstance(spec, HashPartitionSpec):
        if not spec.keys:
            raise ValueError("hash partitioning needs a key")
        keys = [df[k] for k in spec.keys]
        return df.repartition(spec.n_partitions, *keys) if spec.n_partitions else df.repartition(*keys)
    if isinstance(spec, RangePartitionSpec):
        if not spec.keys:
            raise ValueError("range partitioning needs a key")
        return df.repartitionByRange(spec.n_partitions or _default(df), *order_columns(df, spec.keys))
    if isinstance(spec, UserDefinedPartitionSpec):
        return _by_function(df, spec)
    raise NotImplementedError(f"unknown partition spec: {type(spec).__name__}")


def _default(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_function(df: DataFrame, spec: UserDefinedPartitionSpec) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(PARTITION_ID, T.IntegerType(), False)])
    arrow, n, fn = to_arrow_schema(schema), spec.n_partitions, spec.fn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = fn(b)
                ids = pa.array([int(i) % n for i in (ids.to_pylist() if hasattr(ids, "to_pylist") else ids)], pa.int32())
                if len(ids) != b.num_rows:
                    raise ValueError(f"the partition function gave {len(ids)} ids for {b.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*b.columns, ids], schema=arrow)

    return df.mapInArrow(run, schema).repartitionById(n, F.col(PARTITION_ID)).drop(PARTITION_ID)


def local_limit(df: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` rows of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = n
        for b in batches:
            if left <= 0:
                return
            yield b.slice(0, left)
            left -= b.num_rows

    return df.mapInArrow(run, df.schema)
