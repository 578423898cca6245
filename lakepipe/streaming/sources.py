"""Where streams come from.

Spark's own streaming frames (files, Kafka) are used as they are. A polled Python source is landed: a driver thread
writes each batch as a Parquet file to a shared folder, and Spark's file stream reads it, so batches can be replayed and
the source need not be pickled.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe import shared
from lakepipe.operators.udf import spark_schema
from lakepipe.sources.files import ConnectorMissing


class StreamingSource(ABC):
    """``schema`` is an Arrow schema; ``poll`` gives up to ``batch_size`` rows, or None if there are none now."""

    schema: pa.Schema

    @abstractmethod
    def poll(self, batch_size: int) -> pa.RecordBatch | None: ...

    def close(self) -> None:  # noqa: B027
        pass


def rows_to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Fields that are missing are null, fields that the schema lacks go."""
    return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema=schema)


def decode_json(payload: bytes | str) -> dict | None:
    """None for what is not a JSON object."""
    try:
        row = json.loads(payload)
    except (ValueError, TypeError):
        return None
    return row if isinstance(row, dict) else None


class QueueSource(StreamingSource):
    """Rows that are put in by other threads of the driver."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.rows: queue.Queue[dict] = queue.Queue()

    def put(self, *rows: dict) -> None:
        for r in rows:
            self.rows.put(r)

    def poll(self, batch_size: int) -> pa.RecordBatch | None:
        found: list[dict] = []
        while len(found) < batch_size:
            try:
                found.append(self.rows.get_nowait())
            except queue.Empty:
                break
        return rows_to_batch(found, self.schema) if found else None


class WebSocketSource(QueueSource):
    """JSON messages of a WebSocket, read by a thread that starts at the first poll and connects again after an error.

    Needs the ``websockets`` package, unless ``connect`` is given: a function of the URI that yields messages.
    """

    def __init__(self, uri: str, schema: pa.Schema, reconnect_delay: float = 1.0, connect=None) -> None:
        super().__init__(schema)
        self.uri, self.reconnect_delay = uri, reconnect_delay
        self._connect, self._stop, self._thread = connect or _websocket_messages, threading.Event(), None

    def poll(self, batch_size: int) -> pa.RecordBatch | None:
        if self._thread is None:
            if self._connect is _websocket_messages:
                _websockets()
            self._thread = threading.Thread(target=self._listen, daemon=True)
            self._thread.start()
        return super().poll(batch_size)

    def _listen(self) -> None:
        while not self._stop.is_set():
            try:
                for message in self._connect(self.uri):
                    if (row := decode_json(message)) is not None:
                        self.put(row)
                    if self._stop.is_set():
                        return
            except Exception:  # noqa: BLE001  the far end may go at any time, in any way
                pass
            self._stop.wait(self.reconnect_delay)

    def close(self) -> None:
        self._stop.set()


def _websockets():
    try:
        from websockets.sync import client
    except ImportError as e:
        raise ConnectorMissing("WebSocket streams need the websockets package") from e
    return client


def _websocket_messages(uri: str):
    with _websockets().connect(uri) as socket:
        yield from socket


class KafkaSource(StreamingSource):
    """Polls a consumer object (``poll(timeout)``, messages with ``error()`` and ``value()``); for clusters, use kafka_stream."""

    def __init__(self, consumer, schema: pa.Schema, timeout: float = 0.1) -> None:
        self.consumer, self.schema, self.timeout = consumer, schema, timeout

    def poll(self, batch_size: int) -> pa.RecordBatch | None:
        rows: list[dict] = []
        for _ in range(batch_size):
            message = self.consumer.poll(self.timeout)
            if message is None:
                break
            if not message.error() and (row := decode_json(message.value())) is not None:
                rows.append(row)
        return rows_to_batch(rows, self.schema) if rows else None

    def close(self) -> None:
        self.consumer.close()


def kafka_options(topic: str, bootstrap_servers: str, batch_size: int = 100, group_id: str | None = None, consumer_config: dict | None = None) -> dict[str, str]:
    config = {str(k): str(v) for k, v in (consumer_config or {}).items()}
    start = config.pop("auto.offset.reset", "latest")
    options = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic, "startingOffsets": start, "maxOffsetsPerTrigger": str(batch_size), "kafka.group.id": group_id or f"lakepipe-{topic}"}
    return options | {f"kafka.{k}": v for k, v in config.items()}


def decode_values(df: DataFrame, schema) -> DataFrame:
    """Columns of the JSON objects in ``value``; values that are not JSON objects go."""
    schema = spark_schema(schema)
    text = F.col("value").cast("string")
    parsed = df.select(F.from_json(text, schema).alias("row"), F.get_json_object(text, "$").alias("whole"))
    return parsed.where(F.col("row").isNotNull() & F.col("whole").startswith("{")).select("row.*")


def kafka_stream(spark: SparkSession, topic: str, bootstrap_servers: str, schema, batch_size: int = 100, group_id: str | None = None, consumer_config: dict | None = None) -> DataFrame:
    """A Spark stream of a topic's JSON values; needs Spark's Kafka package."""
    try:
        raw = spark.readStream.format("kafka").options(**kafka_options(topic, bootstrap_servers, batch_size, group_id, consumer_config)).load()
    except Exception as e:
        if "Failed to find data source" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e):
            raise ConnectorMissing("Spark's kafka connector is not on the class path; add its package to spark.jars.packages") from e
        raise
    return decode_values(raw, schema)


class Landing:
    """A thread that polls a source and lands each batch as one file of ``folder``, which the executors see too.

    ``on_error`` is told of an error of the source, and says whether to go on polling.
    """

    def __init__(self, spark: SparkSession, source: StreamingSource, folder: str, batch_size: int, interval: float, on_error: Callable[[Exception], bool]) -> None:
        self.spark, self.source, self.folder, self.batch_size, self.interval, self.on_error = spark, source, folder, batch_size, interval, on_error
        self._stop = threading.Event()
        shared.make(spark, folder)
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> None:
        self._thread.start()

    def land(self) -> bool:
        """Whether there was a batch."""
        batch = self.source.poll(self.batch_size)
        if batch is None or not batch.num_rows:
            return False
        data = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_batches([batch]), data)
        shared.put(self.spark, self.folder, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.parquet", data.getvalue().to_pybytes())
        return True

    def land_all(self) -> None:
        """What there is now, on this thread."""
        while True:
            try:
                if not self.land():
                    return
            except Exception as e:  # noqa: BLE001
                if not self.on_error(e):
                    raise
                return

    def _run(self) -> None:
        while not self._stop.is_set():
            landed = False
            try:
                landed = self.land()
            except Exception as e:  # noqa: BLE001
                if not self.on_error(e):
                    return
            if not landed:
                self._stop.wait(self.interval)

    def stop(self) -> None:
        self._stop.set()
        if self._thread.is_alive() and self._thread is not threading.current_thread():
            self._thread.join(10)

    def frame(self) -> DataFrame:
        return self.spark.readStream.schema(spark_schema(self.source.schema)).option("maxFilesPerTrigger", 1).parquet(self.folder)
