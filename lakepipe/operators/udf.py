"""Python row and batch functions, run over Arrow batches.

Without ``output_schema`` a function is tried on a few rows, when the frame is first used. What it gives later is held to
what it gave then: a column that the schema lacks, or a value that is no value of its column's type, is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Rows that a function without a schema is tried on.
SAMPLE_ROWS = 64


def spark_schema(schema) -> T.StructType:
    """From an Arrow schema, a Spark schema or a DDL string."""
    if isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, str):
        return T._parse_datatype_string(schema)
    if isinstance(schema, pa.Schema):
        return from_arrow_schema(schema, prefer_timestamp_ntz=True)
    raise TypeError(f"not a schema: {type(schema).__name__}")


def _sample(df: DataFrame, what: str) -> pa.Table:
    if df.isStreaming:
        raise ValueError(f"{what} on a stream needs output_schema")
    table = df.limit(SAMPLE_ROWS).toArrow()
    if not table.num_rows:
        raise ValueError(f"{what}: no row to try the function on; give output_schema")
    return table


def _inferred(rows: list[dict], what: str) -> T.StructType:
    if not rows:
        raise ValueError(f"{what}: the function gave no row for the sample; give output_schema")
    names = list(dict.fromkeys(k for row in rows for k in row))
    table = pa.Table.from_pylist([{k: row.get(k) for k in names} for row in rows])
    if untyped := [f.name for f in table.schema if pa.types.is_null(f.type)]:
        raise ValueError(f"{what}: only nulls in {', '.join(untyped)} of the sample; give output_schema")
    return spark_schema(table.schema)


def _kind(t: pa.DataType) -> str:
    if pa.types.is_boolean(t):
        return "boolean"
    if pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_decimal(t):
        return "number"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "text"
    if pa.types.is_binary(t) or pa.types.is_large_binary(t):
        return "binary"
    return "time" if pa.types.is_temporal(t) else "other"


def _fitted(column: pa.Array, field: pa.Field, what: str) -> pa.Array:
    """``column`` in the type of ``field``, if that changes no value."""
    if column.type == field.type or pa.types.is_null(column.type):
        return column if column.type == field.type else column.cast(field.type)
    if _kind(column.type) != _kind(field.type):
        raise TypeError(f"{what}: {field.name} is {field.type}, but the function gave {column.type}; give output_schema")
    try:
        return column.cast(field.type)
    except pa.ArrowInvalid as e:
        raise TypeError(f"{what}: {field.name} is {field.type}, but the function gave {column.type}: {e}; give output_schema") from e


def _column(values: list, field: pa.Field, what: str) -> pa.Array:
    if _kind(field.type) == "other":
        return pa.array(values, field.type)
    try:
        found = pa.array(values)
    except pa.ArrowInvalid as e:
        raise TypeError(f"{what}: the function gave values of several types for {field.name}: {e}") from e
    return _fitted(found, field, what)


def _emit(rows: Iterable[dict], arrow: pa.Schema, what: str) -> pa.RecordBatch:
    rows, known = list(rows), set(arrow.names)
    for row in rows:
        if not row.keys() <= known:
            raise ValueError(f"{what}: the function gave {', '.join(sorted(map(str, row.keys() - known)))}, which the schema lacks; give output_schema")
    return pa.RecordBatch.from_arrays([_column([row.get(f.name) for row in rows], f, what) for f in arrow], schema=arrow)


def filter_rows(df: DataFrame, fn: Callable[[dict], bool]) -> DataFrame:
    """Rows for which ``fn(row)`` is true; the schema stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(fn(r)) for r in b.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_rows(df: DataFrame, fn: Callable[[dict], dict], output_schema=None) -> DataFrame:
    """One row out for each row in."""
    schema = spark_schema(output_schema) if output_schema is not None else _inferred([fn(r) for r in _sample(df, "map").to_pylist()], "map")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _emit((fn(r) for r in b.to_pylist()), arrow, "map")

    return df.mapInArrow(run, schema)


def flatmap_rows(df: DataFrame, fn: Callable[[dict], Iterable[dict]], output_schema=None) -> DataFrame:
    """Any number of rows out for each row in."""
    schema = spark_schema(output_schema) if output_schema is not None else _inferred([x for r in _sample(df, "flatmap").to_pylist() for x in fn(r)], "flatmap")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _emit((x for r in b.to_pylist() for x in fn(r)), arrow, "flatmap")

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], batch_size: int = 1024, output_schema=None) -> DataFrame:
    """``fn`` over batches of ``batch_size`` rows at most."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if output_schema is not None:
        schema = spark_schema(output_schema)
    else:
        head = _sample(df, "map_batches").combine_chunks().to_batches(max_chunksize=batch_size)[0]
        schema = spark_schema(fn(head).schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch_size):
                out = fn(b.slice(at, batch_size))
                if set(out.schema.names) != set(arrow.names):
                    raise ValueError(f"map_batches: the function gave {', '.join(out.schema.names)}, the schema has {', '.join(arrow.names)}; give output_schema")
                yield pa.RecordBatch.from_arrays([_fitted(out.column(f.name), f, "map_batches") for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


# ---- functions for SQL


def by_value(fn: Callable) -> Callable:
    def run(*columns: pa.Array) -> list:
        return [fn(*row) for row in zip(*[c.to_pylist() for c in columns], strict=True)]

    return run


def vectorized(fn: Callable, returns: str):
    """``fn`` of Arrow arrays, as a column function; its result is held to ``returns``."""
    field = to_arrow_schema(spark_schema(f"x {returns}")).field(0)

    def run(*columns: pa.Array) -> pa.Array:
        out = fn(*columns)
        return _column(out, field, "function") if isinstance(out, list) else _fitted(out, field, "function")

    return F.arrow_udf(run, returns, ArrowUDFType.SCALAR)


def grouped(fn: Callable, returns: str):
    """``fn`` of all values of a group, as an aggregate."""

    def run(*columns: pa.Array):
        return fn(*columns)

    return F.arrow_udf(run, returns, ArrowUDFType.GROUPED_AGG)
