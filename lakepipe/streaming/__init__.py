"""Micro-batch streams on Structured Streaming."""

from lakepipe.streaming.frame import GroupedStreamingDataFrame, StreamingDataFrame
from lakepipe.streaming.sinks import CallbackSink, KafkaSink, ParquetSink, Sink, StdioSink
from lakepipe.streaming.sources import KafkaSource, QueueSource, StreamingSource, WebSocketSource

__all__ = [
    "CallbackSink",
    "GroupedStreamingDataFrame",
    "KafkaSink",
    "KafkaSource",
    "ParquetSink",
    "QueueSource",
    "Sink",
    "StdioSink",
    "StreamingDataFrame",
    "StreamingSource",
    "WebSocketSource",
]
