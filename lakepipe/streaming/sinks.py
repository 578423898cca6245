"""Where streams go: each sink gets every batch as a Spark frame."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(ABC):
    """A subclass writes Arrow tables (for results that fit the driver), or overrides ``write_frame`` to stay distributed."""

    @abstractmethod
    def write(self, table: pa.Table) -> None: ...

    def write_frame(self, df: DataFrame, batch_id: int) -> None:
        self.write(df.toArrow())

    def close(self) -> None:  # noqa: B027
        pass


class CallbackSink(Sink):
    def __init__(self, fn: Callable[[pa.Table], None]) -> None:
        self.fn = fn

    def write(self, table: pa.Table) -> None:
        self.fn(table)


class StdioSink(Sink):
    """Prints up to ``max_rows`` rows of a batch; nothing for an empty one."""

    def __init__(self, label: str = "", max_rows: int = 20) -> None:
        self.label, self.max_rows = label, max_rows

    def write(self, table: pa.Table) -> None:
        if table.num_rows:
            if self.label:
                print(f"[{self.label}]")
            print(table.slice(0, self.max_rows).to_pandas().to_string(index=False), flush=True)

    def write_frame(self, df: DataFrame, batch_id: int) -> None:
        self.write(df.limit(self.max_rows).toArrow())


class ParquetSink(Sink):
    """A ``batch=<id>`` folder a batch: a batch that is run again replaces its own folder."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, table: pa.Table) -> None:
        raise NotImplementedError("batches are written by Spark")

    def write_frame(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


class KafkaSink(Sink):
    """Rows as JSON, keyed by ``key_column`` if given.

    With a ``producer`` object (``produce``, ``flush``) the driver sends them; else Spark's Kafka package does.
    """

    def __init__(self, topic: str, bootstrap_servers: str = "", producer_config: dict | None = None, key_column: str | None = None, producer=None) -> None:
        self.topic, self.servers, self.config, self.key, self.producer = topic, bootstrap_servers, producer_config or {}, key_column, producer

    def encoded(self, df: DataFrame) -> DataFrame:
        key = F.col(self.key).cast("string") if self.key else F.lit(None).cast("string")
        return df.select(key.alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def write(self, table: pa.Table) -> None:
        raise NotImplementedError("rows are encoded by Spark")

    def write_frame(self, df: DataFrame, batch_id: int) -> None:
        rows = self.encoded(df)
        if self.producer is not None:
            for r in rows.toLocalIterator():
                self.producer.produce(self.topic, value=r["value"], key=r["key"])
            self.producer.flush()
            return
        options = {"kafka.bootstrap.servers": self.servers, "topic": self.topic} | {f"kafka.{k}": str(v) for k, v in self.config.items()}
        rows.write.format("kafka").options(**options).save()
