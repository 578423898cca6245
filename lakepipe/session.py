"""The way in: readers, SQL over frames, streams, telemetry and the end of it all."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession

from lakepipe import shared, sources
from lakepipe.frame import DataFrame, sql_over
from lakepipe.operators import udf
from lakepipe.telemetry import JobEvent, JsonLinesSink, StateObserver


class GlobalContext:
    """The sessions that are open in this process."""

    _lock = threading.Lock()
    _sessions: list[Session] = []

    @classmethod
    def get(cls) -> type[GlobalContext]:
        return cls

    @classmethod
    def sessions(cls) -> list[Session]:
        with cls._lock:
            return list(cls._sessions)

    @classmethod
    def register_session(cls, session: Session) -> None:
        with cls._lock:
            cls._sessions.append(session)

    @classmethod
    def forget(cls, session: Session) -> None:
        with cls._lock:
            if session in cls._sessions:
                cls._sessions.remove(session)

    @classmethod
    def stop_all(cls) -> None:
        for s in cls.sessions():
            s.stop()

    @classmethod
    def reset(cls) -> None:
        with cls._lock:
            cls._sessions.clear()


class Session:
    """Over a Spark session that is given (and then never stopped here), found, or made.

    ``master``: of a cluster; else ``local[n_workers]``. ``conf``: Spark settings for a session that is made.
    """

    def __init__(self, local: bool = True, n_workers: int = 4, temp_dir: str | None = None, master: str | None = None, conf: dict | None = None, telemetry: bool = False, telemetry_log: str | None = None, spark: SparkSession | None = None) -> None:
        found = spark or SparkSession.getActiveSession()
        self._own = found is None
        if found is None:
            builder = SparkSession.builder.appName("lakepipe").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.ansi.doubleQuotedIdentifiers", "true")
            if master or local:
                builder = builder.master(master or f"local[{n_workers}]")
            if local and not master:
                builder = builder.config("spark.sql.shuffle.partitions", str(max(8, 2 * n_workers))).config("spark.ui.enabled", "false")
            for k, v in (conf or {}).items():
                builder = builder.config(k, v)
            found = builder.getOrCreate()
        self.spark = found
        self._temp = temp_dir
        self._own_temp = temp_dir is None
        self.observer = StateObserver()
        self._sink: tuple[int, JsonLinesSink] | None = None
        self._stopped = False
        GlobalContext.register_session(self)
        if telemetry or telemetry_log:
            self.enable_telemetry(telemetry_log)

    # ---- readers

    def _frame(self, df) -> DataFrame:
        return DataFrame(df, self)

    def read_parquet(self, path, n_partitions: int | None = None, filesystem: str | None = None, schema=None, merge_schema: bool = False) -> DataFrame:
        return self._frame(sources.read_parquet(self.spark, path, n_partitions, filesystem, schema, merge_schema))

    def read_csv(self, path, n_partitions: int | None = None, filesystem: str | None = None, delimiter: str = ",", has_header: bool = True, schema=None, **options) -> DataFrame:
        return self._frame(sources.read_csv(self.spark, path, n_partitions, filesystem, delimiter, has_header, schema, **options))

    def read_json(self, path, n_partitions: int | None = None, filesystem: str | None = None, schema=None, **options) -> DataFrame:
        """A JSON object a line."""
        return self._frame(sources.read_files(self.spark, "json", path, n_partitions, filesystem, schema, **options))

    def read_orc(self, path, n_partitions: int | None = None, filesystem: str | None = None, schema=None) -> DataFrame:
        return self._frame(sources.read_files(self.spark, "orc", path, n_partitions, filesystem, schema))

    def read_jdbc(self, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, n_partitions: int = 8, **properties) -> DataFrame:
        return self._frame(sources.read_jdbc(self.spark, url, table, column, bounds, n_partitions, **properties))

    def read_delta(self, path: str, filesystem: str | None = None, version: int | None = None) -> DataFrame:
        return self._frame(sources.read_delta(self.spark, path, filesystem, version))

    def read_kafka(self, topic: str, bootstrap_servers: str, consumer_config: dict | None = None) -> DataFrame:
        return self._frame(sources.read_kafka(self.spark, topic, bootstrap_servers, consumer_config))

    def from_arrow(self, table, n_partitions: int = 1) -> DataFrame:
        return self._frame(sources.from_arrow(self.spark, table, n_partitions))

    def from_pandas(self, pdf, n_partitions: int = 1) -> DataFrame:
        return self._frame(sources.from_pandas(self.spark, pdf, n_partitions))

    def from_spark(self, df) -> DataFrame:
        return self._frame(df)

    def parquet_schema(self, path: str, filesystem: str | None = None):
        return sources.schema_of_parquet(self.spark, path, filesystem)

    def sql(self, query: str, **frames: DataFrame) -> DataFrame:
        """SQL over frames by name: ``session.sql("SELECT … FROM a JOIN b …", a=x, b=y)``."""
        if not frames:
            raise ValueError("session.sql needs a frame for each name in the query")
        out = sql_over(self.spark, query, {k: f.spark_frame for k, f in frames.items()})
        return DataFrame(out, self, tuple(f._flush for f in frames.values() if f._pending))

    def register_function(self, name: str, fn: Callable, returns: str, vectorized: bool = False) -> None:
        """``fn`` as a function in SQL and expressions. It gets a value of each argument, or with ``vectorized`` an Arrow array of
        each (and gives one); ``returns`` is the type of the result, as in SQL."""
        self.spark.udf.register(name, udf.vectorized(fn if vectorized else udf.by_value(fn), returns))

    def register_aggregate(self, name: str, fn: Callable, returns: str) -> None:
        """``fn`` as an aggregate in SQL, expressions and agg(): it gets an Arrow array of each argument, all values of a group, and
        gives one value. A group has to fit in a task, and rows are shuffled as they are; built-in aggregates need neither."""
        self.spark.udf.register(name, udf.grouped(fn, returns))

    # ---- streams

    def read_stream(self, source, batch_size: int = 100, n_partitions: int = 1, partition_by=None, partition_fn=None):
        """A StreamingDataFrame over a source that is polled (streaming.sources.StreamingSource) or a streaming Spark frame."""
        from lakepipe.streaming import StreamingDataFrame

        return StreamingDataFrame.over(self, [source], batch_size, n_partitions, partition_by, partition_fn)

    def read_kafka_stream(self, topic: str, bootstrap_servers: str, schema, batch_size: int = 100, group_id: str | None = None, consumer_config: dict | None = None, **partitioning):
        from lakepipe.streaming.sources import kafka_stream

        return self.read_stream(kafka_stream(self.spark, topic, bootstrap_servers, schema, batch_size, group_id, consumer_config), batch_size, **partitioning)

    def read_websocket_stream(self, uri: str, schema, batch_size: int = 50, reconnect_delay: float = 1.0, **partitioning):
        from lakepipe.streaming.sources import WebSocketSource

        return self.read_stream(WebSocketSource(uri, schema, reconnect_delay), batch_size, **partitioning)

    def read_file_stream(self, path: str, schema, format: str = "parquet", batch_size: int = 1, **options):  # noqa: A002
        """Files as they come into a folder, ``batch_size`` a batch."""
        df = self.spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", batch_size).options(**options).load(path)
        return self.read_stream(df, batch_size)

    # ---- telemetry

    def enable_telemetry(self, log_path: str | None = None) -> None:
        self.disable_telemetry()
        if log_path:
            sink = JsonLinesSink(log_path)
            self._sink = (self.observer.subscribe(sink), sink)

    def disable_telemetry(self) -> None:
        if self._sink:
            self.observer.unsubscribe(self._sink[0])
            self._sink[1].close()
            self._sink = None

    def telemetry_summary(self) -> dict:
        return self.observer.summary()

    def on_job_event(self, fn: Callable[[JobEvent], None]) -> int:
        """Returns what ``observer.unsubscribe`` takes."""
        return self.observer.subscribe(fn)

    # ---- lifecycle

    @property
    def scheduler(self):
        """Spark's context, which schedules everything."""
        return self.spark.sparkContext

    @property
    def temp_dir(self) -> str:
        """A folder that the driver and the executors share, named when first asked for: streams land polled batches in it."""
        if self._temp is None:
            self._temp = shared.folder(self.spark)
        return self._temp

    def stop(self) -> None:
        if self._stopped:
            return
        self._stopped = True
        self.disable_telemetry()
        GlobalContext.forget(self)
        if self._own_temp and self._temp:
            shared.remove(self.spark, self._temp)
        if self._own:
            self.spark.stop()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *exc) -> None:
        self.stop()

    def __repr__(self) -> str:
        return f"Session(master={self.spark.sparkContext.master!r}, own={self._own}, stopped={self._stopped})"
