"""Streaming frames: a source, steps and sinks.

Steps before the first group-by run as Spark's streaming plan; a group-by (which starts anew with each batch) and what
follows it run on the batch. Totals that outlive a batch: ``windowed`` and ``deduplicated``, which keep state.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from lakepipe.frame import DataFrame, sql_over
from lakepipe.operators import joins, partitioning, udf
from lakepipe.operators.aggregate import aggregate, columns_of
from lakepipe.streaming.sinks import KafkaSink, ParquetSink, Sink, StdioSink
from lakepipe.streaming.sources import Landing, StreamingSource


def _union(frames: list[SparkFrame]) -> SparkFrame:
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return df


class GroupedStreamingDataFrame:
    def __init__(self, frame: StreamingDataFrame, keys: list[str]) -> None:
        self._frame, self._keys = frame, keys

    def agg(self, aggs: dict) -> StreamingDataFrame:
        keys = self._keys
        return self._frame._step(f"groupby({', '.join(keys)}).agg({aggs})", lambda df: aggregate(df, keys, aggs), per_batch=True)

    def count(self) -> StreamingDataFrame:
        return self.agg({"*": "count"})

    def sum(self, *columns: str) -> StreamingDataFrame:
        return self.agg(dict.fromkeys(columns, "sum"))

    def mean(self, *columns: str) -> StreamingDataFrame:
        return self.agg(dict.fromkeys(columns, "mean"))

    def min(self, *columns: str) -> StreamingDataFrame:
        return self.agg(dict.fromkeys(columns, "min"))

    def max(self, *columns: str) -> StreamingDataFrame:
        return self.agg(dict.fromkeys(columns, "max"))


class StreamingDataFrame:
    """Immutable: each method gives a new one. ``steps``: (text, function, whether it is for a batch only)."""

    def __init__(self, session, inputs, batch_size: int = 100, spec=None, steps=(), sinks=(), stateful: bool = False, build=None) -> None:
        """``build``: the plan that the steps start from, of the frames of all inputs; by default their union."""
        self._session, self._inputs, self._batch_size, self._spec = session, tuple(inputs), batch_size, spec
        self._steps, self._sinks, self._stateful, self._build = tuple(steps), tuple(sinks), stateful, build or _union
        self._query = None
        self._failure: Exception | None = None
        self._landings: list[Landing] = []

    @classmethod
    def over(cls, session, inputs, batch_size: int = 100, n_partitions: int = 1, partition_by=None, partition_fn=None) -> StreamingDataFrame:
        if partition_by is not None and partition_fn is not None:
            raise ValueError("give partition_by or partition_fn, not both")
        for x in inputs:
            if not isinstance(x, (StreamingSource, SparkFrame)) or isinstance(x, SparkFrame) and not x.isStreaming:
                raise TypeError("a stream comes from a StreamingSource or a streaming Spark frame")
        spec = None
        if partition_fn is not None:
            spec = partitioning.UserDefinedPartitionSpec(partition_fn, n_partitions)
        elif partition_by is not None:
            spec = partitioning.HashPartitionSpec([partition_by] if isinstance(partition_by, str) else list(partition_by), n_partitions)
        elif n_partitions > 1:
            spec = partitioning.EvenPartitionSpec(n_partitions)
        return cls(session, inputs, batch_size, spec)

    def _copy(self, **changes) -> StreamingDataFrame:
        now = {"session": self._session, "inputs": self._inputs, "batch_size": self._batch_size, "spec": self._spec, "steps": self._steps, "sinks": self._sinks, "stateful": self._stateful, "build": self._build}
        return StreamingDataFrame(**now | changes)

    def _step(self, text: str, fn: Callable, per_batch: bool = False, **changes) -> StreamingDataFrame:
        per_batch = per_batch or any(s[2] for s in self._steps)
        return self._copy(steps=(*self._steps, (text, fn, per_batch)), **changes)

    # ---- steps

    def filter(self, predicate) -> StreamingDataFrame:
        if callable(predicate):
            return self._step("filter(function)", lambda df: udf.filter_rows(df, predicate))
        return self._step(f"filter({predicate})", lambda df: df.where(predicate))

    def select(self, *columns: str) -> StreamingDataFrame:
        return self._step(f"select({', '.join(columns)})", lambda df: df.selectExpr(*columns))

    def map(self, fn, output_schema=None) -> StreamingDataFrame:
        return self._step("map", lambda df: udf.map_rows(df, fn, output_schema), per_batch=output_schema is None)

    def flatmap(self, fn, output_schema=None) -> StreamingDataFrame:
        return self._step("flatmap", lambda df: udf.flatmap_rows(df, fn, output_schema), per_batch=output_schema is None)

    def map_batches(self, fn, batch_size: int = 1024, output_schema=None) -> StreamingDataFrame:
        return self._step("map_batches", lambda df: udf.map_batches(df, fn, batch_size, output_schema), per_batch=output_schema is None)

    def sql(self, query: str) -> StreamingDataFrame:
        """SQL over each batch, called ``this``."""
        return self._step(f"sql({query})", lambda df: sql_over(df.sparkSession, query, {"this": df}), per_batch=True)

    def groupby(self, *keys: str) -> GroupedStreamingDataFrame:
        return GroupedStreamingDataFrame(self, list(keys))

    def repartition(self, n_partitions: int = 1, partition_by=None, partition_fn=None) -> StreamingDataFrame:
        return self._copy(spec=StreamingDataFrame.over(self._session, self._inputs, self._batch_size, n_partitions, partition_by, partition_fn)._spec)

    def union(self, other: StreamingDataFrame) -> StreamingDataFrame:
        """Both sources in each batch; neither may have steps yet."""
        if self._steps or other._steps:
            raise ValueError("only sources can be put together")
        return self._copy(inputs=(*self._inputs, *other._inputs))

    def watermarked(self, time_column: str, watermark: str) -> StreamingDataFrame:
        """Rows may be late by ``watermark``; joins and windows forget what is older."""
        return self._step(f"watermarked({time_column}, {watermark})", lambda df: df.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, watermark))

    def join(self, other, on=None, how: str = "inner", times: tuple[str, str] | None = None, within: str | None = None, right_suffix: str = "_right") -> StreamingDataFrame:
        """With a frame (the same in each batch) or another stream, as operators.joins.join.

        Streams remember each other's rows, of all time unless both are watermarked() and ``times`` (a time of either side)
        are to be ``within`` an interval of each other. An outer or semi join of streams needs that.
        """
        if on is None:
            raise ValueError("a join needs a key")
        if isinstance(other, DataFrame):
            return self._step(f"join({on}, {how})", lambda df: joins.join(df, other.spark_frame, on, how, right_suffix=right_suffix))
        if not isinstance(other, StreamingDataFrame):
            raise TypeError("a stream is joined to a frame or a stream")
        if any(s[2] for s in (*self._steps, *other._steps)):
            raise ValueError("streams can be joined only before steps that are for a batch")
        if within is not None and times is None:
            raise ValueError("within needs the times that it is about")
        n = len(self._inputs)

        def build(frames: list[SparkFrame]) -> SparkFrame:
            left, right = self._plan(frames[:n]), other._plan(frames[n:])
            if within is None:
                return joins.join(left, right, on, how, right_suffix=right_suffix)
            return joins.join_within(left, right, on, times, within, how, right_suffix=right_suffix)

        return self._copy(inputs=(*self._inputs, *other._inputs), steps=(), build=build, stateful=True)

    def with_state(self, keys, fn: Callable, output_schema, state_schema, timeout: str = "none") -> StreamingDataFrame:
        """``fn(key, frames, state)`` for each key in each batch: gets pandas frames and a state (of ``state_schema``) that outlives
        batches, yields pandas frames of ``output_schema``. ``timeout``: ``none``, ``processing`` or ``event``."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        kind = {"none": "NoTimeout", "processing": "ProcessingTimeTimeout", "event": "EventTimeTimeout"}[timeout]
        out, state = udf.spark_schema(output_schema), udf.spark_schema(state_schema)
        return self._step(f"with_state({', '.join(keys)})", lambda df: df.groupBy(*keys).applyInPandasWithState(fn, out, state, "append", kind), stateful=True)

    def windowed(self, time_column: str, size: str, slide: str | None = None, keys=(), aggs: dict | None = None, watermark: str = "0 seconds", session_gap: bool = False) -> StreamingDataFrame:
        """Event-time windows (tumbling, sliding with ``slide``, or sessions of gap ``size``) that outlive batches.

        A window is given once, when the watermark passes its end; rows later than that are dropped by Spark.
        """
        keys, aggs = list(keys), aggs or {"*": "count"}

        def run(df: SparkFrame) -> SparkFrame:
            # Spark takes no watermark on timestamps without a zone
            df = df.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, watermark)
            w = F.session_window(time_column, size) if session_gap else F.window(time_column, size, slide or size)
            out = df.groupBy(w.alias("w"), *keys).agg(*columns_of(aggs))
            return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])

        return self._step(f"windowed({time_column}, {size})", run, stateful=True)

    def deduplicated(self, columns: list[str], time_column: str, watermark: str) -> StreamingDataFrame:
        """The first row of each key, within the watermark."""
        return self._step(f"deduplicated({', '.join(columns)})", lambda df: df.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, watermark).dropDuplicatesWithinWatermark(columns), stateful=True)

    def to(self, *sinks: Sink) -> StreamingDataFrame:
        return self._copy(sinks=(*self._sinks, *sinks))

    # ---- running

    def spark_frame(self, inputs: list[SparkFrame] | None = None) -> SparkFrame:
        """The streaming plan up to the first step that is for a batch."""
        frames = inputs if inputs is not None else [x for x in self._inputs if isinstance(x, SparkFrame)]
        if len(frames) != len(self._inputs):
            raise ValueError("a polled source has no plan before it is started")
        return self._plan(frames)

    def _plan(self, frames: list[SparkFrame]) -> SparkFrame:
        df = self._build(frames)
        for _, fn, per_batch in self._steps:
            if per_batch:
                break
            df = fn(df)
        return df

    def start(self, batch_interval: float = 1.0, checkpoint: str | None = None, available_now: bool = False, error_handler: Callable[[Exception], None] | None = None) -> StreamingDataFrame:
        """Starts in the background. ``available_now``: takes what is there and ends.

        ``checkpoint``: a folder that makes the query go on where it ended. ``error_handler`` gets the error of a batch,
        which is then given up, and those of a polled source, which is then polled on; without it the query ends with the
        error, which run(), process_available() and stop() raise.
        """
        if not self._sinks:
            raise ValueError("a stream needs a sink")
        if self._query is not None:
            raise RuntimeError("already started")
        spark, frames = self._session.spark, []

        def failed(e: Exception) -> bool:
            if error_handler is not None:
                error_handler(e)
                return True
            self._failure = e
            if self._query is not None:
                self._query.stop()
            return False

        for x in self._inputs:
            if isinstance(x, StreamingSource):
                landing = Landing(spark, x, f"{self._session.temp_dir}/landing-{uuid.uuid4().hex}", self._batch_size, min(batch_interval, 0.1), failed)
                self._landings.append(landing)
                if available_now:
                    landing.land_all()
                frames.append(landing.frame())
            else:
                frames.append(x)
        df = self.spark_frame(frames)
        later = [fn for _, fn, per_batch in self._steps if per_batch]

        def batch(frame: SparkFrame, batch_id: int) -> None:
            try:
                with self._session.observer.observe_batch(f"batch {batch_id}") as found:
                    frame.persist()
                    try:
                        found["rows_in"] = frame.count()
                        if not found["rows_in"]:
                            return
                        out = partitioning.repartition(frame, self._spec) if self._spec is not None else frame
                        for fn in later:
                            out = fn(out)
                        out.persist()
                        try:
                            found["rows_out"] = out.count()
                            for sink in self._sinks:
                                sink.write_frame(out, batch_id)
                        finally:
                            out.unpersist()
                    finally:
                        frame.unpersist()
            except Exception as e:
                if error_handler is None:
                    raise
                error_handler(e)

        writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{self._session.temp_dir}/stream-{uuid.uuid4().hex}")
        if self._stateful:
            writer = writer.outputMode("append")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{max(1, round(batch_interval * 1000))} milliseconds")
        self._query = writer.start()
        if not available_now:
            for landing in self._landings:
                landing.start()
        return self

    def run(self, batch_interval: float = 1.0, **how) -> StreamingDataFrame:
        """Starts and waits; an interrupt ends it in good order."""
        self.start(batch_interval, **how)
        try:
            self._query.awaitTermination()
        except KeyboardInterrupt:
            pass
        finally:
            self.stop(drain=False)
        return self

    def start_background(self, batch_interval: float = 1.0, **how) -> threading.Thread:
        """Starts, and gives a thread that ends when the query does."""
        self.start(batch_interval, **how)
        thread = threading.Thread(target=self._query.awaitTermination, daemon=True)
        thread.start()
        return thread

    def process_available(self) -> None:
        """Waits until all that has landed is through."""
        if self._failure is None:
            self._query.processAllAvailable()
        self._raise()

    def _raise(self) -> None:
        failure, self._failure = self._failure, None
        if failure is not None:
            raise failure

    def stop(self, drain: bool = True) -> None:
        """Stops polling, finishes what has landed (with ``drain``), ends the query, closes sources and sinks."""
        for x in self._landings:
            x.stop()
        try:
            if self._query is not None and self._query.isActive:
                if drain:
                    self._query.processAllAvailable()
                self._query.stop()
        finally:
            for x in self._inputs:
                if isinstance(x, StreamingSource):
                    x.close()
            for s in self._sinks:
                s.close()
        self._raise()

    def write_stdio(self, label: str = "", max_rows: int = 20, batch_interval: float = 1.0, **how) -> StreamingDataFrame:
        return self.to(StdioSink(label, max_rows)).run(batch_interval, **how)

    def write_kafka(self, topic: str, bootstrap_servers: str, producer_config: dict | None = None, key_column: str | None = None, batch_interval: float = 1.0, **how) -> StreamingDataFrame:
        return self.to(KafkaSink(topic, bootstrap_servers, producer_config, key_column)).run(batch_interval, **how)

    def write_parquet(self, path: str, batch_interval: float = 1.0, **how) -> StreamingDataFrame:
        return self.to(ParquetSink(path)).run(batch_interval, **how)

    def write(self, sink: Sink, batch_interval: float = 1.0, **how) -> StreamingDataFrame:
        return self.to(sink).run(batch_interval, **how)

    def explain(self) -> str:
        names = [type(x).__name__ for x in self._inputs]
        lines = [f"source: {', '.join(names)}; {self._batch_size} rows a batch; {self._spec or 'partitions as they come'}"]
        lines += [f"{'each batch' if per_batch else 'stream'}: {text}" for text, _, per_batch in self._steps]
        lines += [f"sink: {type(s).__name__}" for s in self._sinks]
        print(out := "\n".join(lines))
        return out
