"""Readers and writers of files and in-memory data."""

from lakepipe.sources.files import read_csv, read_delta, read_files, read_jdbc, read_kafka, read_parquet, schema_of_parquet
from lakepipe.sources.memory import from_arrow, from_pandas
from lakepipe.sources.sinks import write_csv, write_files, write_parquet

__all__ = [
    "from_arrow",
    "from_pandas",
    "read_csv",
    "read_delta",
    "read_files",
    "read_jdbc",
    "read_kafka",
    "read_parquet",
    "schema_of_parquet",
    "write_csv",
    "write_files",
    "write_parquet",
]
