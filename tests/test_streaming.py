import time

import pyarrow as pa
import pytest

from lakepipe.sources.files import ConnectorMissing
from lakepipe.streaming import CallbackSink, KafkaSink, KafkaSource, QueueSource, Sink, StdioSink, StreamingSource, WebSocketSource
from lakepipe.streaming.sources import decode_values, kafka_options

SCHEMA = pa.schema([("g", pa.string()), ("v", pa.int64())])


def queued(*rows):
    q = QueueSource(SCHEMA)
    q.put(*[{"g": g, "v": v} for g, v in rows])
    return q


def run(stream, **how):
    out = []
    stream.to(CallbackSink(lambda t: out.append(t.to_pylist()))).run(available_now=True, **how)
    return out


def test_stateless_steps(session):
    got = run(session.read_stream(queued(("a", 1), ("b", -1), ("a", 2)), batch_size=2).filter("v > 0").filter(lambda r: r["v"] < 9).select("v * 2 AS w").map(lambda r: {"w": r["w"] + 1}, output_schema="w long").flatmap(lambda r: [r, r]))
    assert sorted(r["w"] for b in got for r in b) == [3, 3, 5, 5]


def test_groups_start_anew_with_each_batch(session):
    rows = [("a", 1), ("a", 3), ("b", 5), ("a", 10)]
    got = run(session.read_stream(queued(*rows), batch_size=3).groupby("g").mean("v"))
    assert [{r["g"]: r["v"] for r in b} for b in got] == [{"a": 2.0, "b": 5.0}, {"a": 10.0}]
    counts = run(session.read_stream(queued(*rows), batch_size=4, n_partitions=2).groupby("g").count().filter("`count` > 1"))
    assert counts == [[{"g": "a", "count": 3}]]
    for name in ("sum", "min", "max"):
        assert run(getattr(session.read_stream(queued(*rows)).groupby("g"), name)("v"))


def test_two_sources_and_partitions(session):
    s = session.read_stream(queued(("a", 1))).union(session.read_stream(queued(("b", 2))))
    assert sorted(r["v"] for b in run(s) for r in b) == [1, 2]
    with pytest.raises(ValueError):
        session.read_stream(queued(), partition_by="g", partition_fn=lambda b: [])
    assert run(session.read_stream(queued(("a", 1), ("b", 2)), n_partitions=2, partition_fn=lambda b: [0] * b.num_rows).sql("SELECT count(*) AS n FROM this")) == [[{"n": 2}]]
    assert run(session.read_stream(queued(("a", 1))).repartition(2, partition_by="g")) == [[{"g": "a", "v": 1}]]


def test_guards(session):
    s = session.read_stream(queued())
    with pytest.raises(ValueError):
        s.join(s)
    with pytest.raises(ValueError):
        s.start()
    with pytest.raises(TypeError):
        session.read_stream([1, 2])
    with pytest.raises(ValueError):
        s.filter("v > 0").union(s)
    assert "filter(v > 0)" in s.filter("v > 0").to(StdioSink()).explain()
    assert s._steps == ()


def test_empty_batches_reach_no_sink(session):
    assert run(session.read_stream(queued())) == []


def test_background_errors_and_stop(session):
    q, out, errors = queued(("a", 1)), [], []

    class Fails(Sink):
        closed = False

        def write(self, table):
            out.append(table.num_rows)
            raise RuntimeError("no")

        def close(self):
            Fails.closed = True

    s = session.read_stream(q).to(Fails())
    thread = s.start_background(0.05, error_handler=errors.append)
    for _ in range(200):
        if errors:
            break
        time.sleep(0.1)
    s.stop()
    thread.join(10)
    assert out == [1] and "no" in str(errors[0]) and Fails.closed and not thread.is_alive()
    with pytest.raises(RuntimeError):
        s.start()


class Broken(QueueSource):
    """Fails at its second poll, and again at each third."""

    polls = 0

    def poll(self, batch_size):
        self.polls += 1
        if self.polls % 3 == 2:
            raise OSError("gone")
        return super().poll(batch_size)


def test_errors_of_a_source(session):
    def source():
        b = Broken(SCHEMA)
        b.put(*[{"g": "a", "v": i} for i in range(6)])
        return b

    # without a handler the query ends with the error
    s = session.read_stream(source(), batch_size=1).to(CallbackSink(lambda t: None)).start(0.05)
    with pytest.raises(OSError, match="gone"):
        for _ in range(200):
            s.process_available()
            time.sleep(0.05)
    assert not s._query.isActive
    with pytest.raises(OSError, match="gone"):
        session.read_stream(source(), batch_size=1).to(CallbackSink(lambda t: None)).run(available_now=True)
    with pytest.raises(OSError, match="gone"):
        session.read_stream(source(), batch_size=1).to(CallbackSink(lambda t: None)).run(0.05)
    # with one it polls on
    out, errors = [], []
    s = session.read_stream(source(), batch_size=1).to(CallbackSink(lambda t: out.extend(t.column("v").to_pylist())))
    thread = s.start_background(0.05, error_handler=errors.append)
    for _ in range(300):
        if len(out) == 6:
            break
        time.sleep(0.1)
    s.stop()
    thread.join(10)
    assert sorted(out) == list(range(6)) and errors and isinstance(errors[0], OSError)


def test_stdio(session, capsys):
    session.read_stream(queued(("a", 1), ("b", 2))).write_stdio("label", max_rows=1, available_now=True)
    printed = capsys.readouterr().out
    assert "[label]" in printed and len(printed.strip().splitlines()) == 3


class Message:
    def __init__(self, value, error=None):
        self._value, self._error = value, error

    def value(self):
        return self._value

    def error(self):
        return self._error


def test_kafka_source_and_sink(session):
    class Consumer:
        def __init__(self):
            self.left, self.closed = [Message(b'{"g": "a", "v": 1, "x": 2}'), Message(b"", "bad"), Message(b"{no"), Message(b"[1]"), Message(b'{"v": 3}')], False

        def poll(self, timeout):
            return self.left.pop(0) if self.left else None

        def close(self):
            self.closed = True

    class Producer:
        sent, flushed = [], 0

        def produce(self, topic, value, key):
            self.sent.append((topic, key, value))

        def flush(self):
            Producer.flushed += 1

    c = Consumer()
    session.read_stream(KafkaSource(c, SCHEMA)).to(KafkaSink("t", key_column="g", producer=Producer())).run(available_now=True)
    assert sorted(Producer.sent, key=str) == sorted([("t", "a", '{"g":"a","v":1}'), ("t", None, '{"g":null,"v":3}')], key=str) and Producer.flushed == 1 and c.closed


def test_kafka_options_and_values(session):
    o = kafka_options("t", "h:1", 50, consumer_config={"auto.offset.reset": "earliest", "security.protocol": "SSL"})
    assert o == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "50", "kafka.group.id": "lakepipe-t", "kafka.security.protocol": "SSL"}
    df = session.spark.createDataFrame([('{"g":"a","v":1}',), ("{no",), ("[1]",), (None,), ('{"v":2,"z":1}',)], "value string")
    assert sorted((r["v"], r["g"]) for r in decode_values(df, SCHEMA).collect()) == [(1, "a"), (2, None)]


def test_websocket(session):
    calls = []

    def connect(uri):
        calls.append(uri)
        if len(calls) == 1:
            raise OSError("not yet")
        yield from ['{"g": "a", "v": 1}', "no json"]

    w = WebSocketSource("ws://x", SCHEMA, reconnect_delay=0.01, connect=connect)
    for _ in range(200):
        batch = w.poll(5)
        if batch is not None:
            break
        time.sleep(0.02)
    w.close()
    assert batch.to_pylist()[0] == {"g": "a", "v": 1} and calls[0] == "ws://x"
    with pytest.raises((ConnectorMissing, OSError)):
        WebSocketSource("ws://127.0.0.1:1", SCHEMA).poll(1) or (_ for _ in ()).throw(OSError)


def test_polling_is_bounded():
    q = queued(*[("a", i) for i in range(10)])
    assert isinstance(q, StreamingSource) and q.poll(4).num_rows == 4 and q.poll(100).num_rows == 6 and q.poll(1) is None


def test_event_time_windows(session, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    times = [t0 + datetime.timedelta(minutes=m) for m in (1, 2, 61, 62, 200)]
    session.from_arrow(pa.table({"t": pa.array(times, pa.timestamp("us")), "v": [1, 2, 3, 4, 5]})).write_parquet(str(tmp_path / "in")).compute()
    schema = session.read_parquet(str(tmp_path / "in")).schema
    got = run(session.read_file_stream(str(tmp_path / "in"), schema).windowed("t", "1 hour", aggs={"v": "sum"}, watermark="1 minute"))
    assert sorted(r["v"] for b in got for r in b) == [3, 7]  # the last window is still open
    session.read_file_stream(str(tmp_path / "in"), schema).deduplicated(["v"], "t", "1 hour").write_parquet(str(tmp_path / "out"), available_now=True)
    assert session.read_parquet(str(tmp_path / "out")).count() == 5


def _timed(session, tmp_path, name, rows):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    table = pa.table({"k": [k for k, _, _ in rows], "t": pa.array([t0 + datetime.timedelta(minutes=m) for _, m, _ in rows], pa.timestamp("us")), "v": [v for _, _, v in rows]})
    session.from_arrow(table).write_parquet(str(tmp_path / name)).compute()
    return session.read_file_stream(str(tmp_path / name), session.read_parquet(str(tmp_path / name)).schema)


def test_joins_of_streams(session, tmp_path):
    names = session.from_arrow(pa.table({"g": ["a", "b"], "name": ["A", "B"]}))
    got = run(session.read_stream(queued(("a", 1), ("b", 2), ("c", 3)), batch_size=2).join(names, "g", "left").filter("v < 3 OR name IS NULL"))
    assert sorted((r["g"], r["v"], r["name"]) for b in got for r in b) == [("a", 1, "A"), ("b", 2, "B"), ("c", 3, None)]
    left, right = _timed(session, tmp_path, "l", [("x", 0, 1), ("x", 100, 2), ("y", 0, 3)]), _timed(session, tmp_path, "r", [("x", 10, 7), ("x", 300, 8), ("z", 0, 9)])
    both = left.watermarked("t", "1 minute").join(right.watermarked("t", "1 minute"), "k", times=("t", "t"), within="30 minutes")
    assert [(r["k"], r["v"], r["v_right"]) for b in run(both) for r in b] == [("x", 1, 7)]
    assert sorted((r["v"], r["v_right"]) for b in run(left.join(right.select("k", "v"), "k").filter("v > 0")) for r in b) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    two = session.read_stream(queued(("a", 1)))
    assert [r["v_right"] for b in run(two.join(session.read_stream(queued(("a", 5), ("b", 6))), "g")) for r in b] == [5]
    for bad in (lambda: two.join(two.groupby("g").count(), "g"), lambda: two.join(two, "g", within="1 hour")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        two.join([1], "g")


def test_a_state_of_ones_own(session):
    import pandas as pd

    def total(key, frames, state):
        n = (state.get[0] if state.exists else 0) + sum(int(f["v"].sum()) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"g": [key[0]], "total": [n]})

    got = run(session.read_stream(queued(("a", 1), ("a", 2), ("b", 5), ("a", 10)), batch_size=2).with_state("g", total, "g string, total long", "n long"))
    assert [sorted((r["g"], r["total"]) for r in b) for b in got if b] == [[("a", 3)], [("a", 13), ("b", 5)]]
