import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lakepipe import GlobalContext, HashPartitionSpec, RangePartitionSpec, Session, UserDefinedPartitionSpec
from lakepipe.functions import aggregate_column, check_dialect
from lakepipe.operators import joins
from lakepipe.sources.files import ConnectorMissing, uri


@pytest.fixture
def people(session):
    return session.from_arrow(pa.table({"id": [1, 2, 3, 4, 5], "name": list("abcde"), "age": [30, 25, 35, 28, 22], "score": [1.5, 2.5, 3.5, 4.5, 5.5]}))


@pytest.fixture
def grouped(session):
    return session.from_arrow(pa.table({"group": ["a", "b", "a", "b", "a", "b"], "val": [1, 3, 2, 4, 3, 8]}), n_partitions=3)


def rows(df):
    return sorted(df.to_arrow().to_pylist(), key=str)


def test_filter_select_limit(people):
    assert people.filter("age > 26").filter(lambda r: r["score"] < 4).select("id", "age * 2 AS twice").to_arrow().to_pylist() == [{"id": 1, "twice": 60}, {"id": 3, "twice": 70}]
    assert people.limit(2).count() == 2 and people.repartition(4).limit(3).count() == 3
    assert people.limit(2).filter("id >= 1").count() == 2  # in the order that was asked for
    assert people.limit(4).limit(2).count() == 2
    assert people.select("age * 2 AS age").filter("age > 60").count() == 1  # the projected column
    assert people.select("id + 1 AS x").select("x").columns == ["x"]


def test_local_limit(people):
    parts = people.spark_frame.repartition(3).rdd.getNumPartitions()
    assert people.repartition(3).local_limit(1).count() <= parts


def test_frames_do_not_change(people):
    before = people.columns
    people.with_column("x", "1").drop("id").rename({"name": "n"})
    assert people.columns == before and "DataFrame[id: bigint" in repr(people)


def test_functions(people, session):
    assert people.map(lambda r: {"id": r["id"], "next": r["age"] + 1}).to_arrow().column("next").to_pylist() == [31, 26, 36, 29, 23]
    assert people.flatmap(lambda r: [{"c": r["name"]}] * 2).count() == 10
    sizes = people.map_batches(lambda b: pa.record_batch({"n": [b.num_rows]}), batch_size=2, output_schema=pa.schema([("n", pa.int64())]))
    assert max(sizes.to_arrow().column("n").to_pylist()) <= 2 and sum(sizes.to_arrow().column("n").to_pylist()) == 5
    empty = people.filter("id > 99")
    assert empty.map(lambda r: r, output_schema=empty.schema).count() == 0
    with pytest.raises(ValueError, match="output_schema"):
        empty.map(lambda r: r).count()
    with pytest.raises(ValueError, match="only nulls"):
        people.map(lambda r: {"x": None}).columns
    with pytest.raises(ValueError):
        people.map_batches(lambda b: b, batch_size=0)


def test_functions_are_tried_when_their_frame_is_used(session, people):
    calls = session.spark.sparkContext.accumulator(0)

    def counted(r):
        calls.add(1)
        return {"id": r["id"] + 1}

    late = people.map(counted).filter("id > 3").select("id").union(people.select("id"))
    assert calls.value == 0  # no job for a plan
    assert late.count() == 8 and calls.value > 0


def test_what_a_function_gives_later_is_held_to_its_schema(session):
    many = session.from_spark(session.spark.range(0, 200, 1, 1))
    grown = many.map(lambda r: {"id": r["id"]} | ({"late": 1} if r["id"] > 100 else {}))
    assert grown.columns == ["id"]
    cases = [
        grown,
        many.map(lambda r: {"x": r["id"] if r["id"] < 100 else r["id"] + 0.5}),
        many.map(lambda r: {"x": r["id"] if r["id"] < 100 else "12"}),
        many.flatmap(lambda r: [{"x": True if r["id"] < 100 else 3}]),
        many.map_batches(lambda b: b if b.column("id")[0].as_py() == 0 else b.rename_columns(["other"]), batch_size=64),
        many.map_batches(lambda b: b if b.column("id")[0].as_py() == 0 else pa.record_batch({"id": ["x"] * b.num_rows}), batch_size=64),
    ]
    for df in cases:
        with pytest.raises(Exception, match="output_schema|several types"):
            df.to_arrow()
    # numbers that fit, and nulls, are no change of type
    assert many.map(lambda r: {"x": r["id"] * 1.0 if r["id"] < 100 else r["id"]}).sql("SELECT sum(x) AS s FROM this").to_arrow().to_pylist() == [{"s": 19900.0}]
    assert many.map(lambda r: {"x": r["id"] if r["id"] % 2 == 0 else None}, output_schema="x long").filter("x IS NULL").count() == 100
    assert many.map(lambda r: {"x": [r["id"]], "y": {"a": str(r["id"])}}).filter("y.a = '7' AND x[0] = 7").count() == 1


def test_functions_in_sql(session, people):
    session.register_function("plus", lambda a, b: None if a is None else a + b, "bigint")
    session.register_function("doubled", lambda a: pc.multiply(a, 2), "bigint", vectorized=True)
    session.register_aggregate("spread", lambda x: pc.max(x).as_py() - pc.min(x).as_py(), "bigint")
    assert people.filter("id < 3").select("plus(id, age) AS p", "doubled(id) AS d").to_arrow().to_pylist() == [{"p": 31, "d": 2}, {"p": 27, "d": 4}]
    assert people.sql("SELECT spread(age) AS s FROM this").to_arrow().to_pylist() == [{"s": 13}]
    assert rows(people.with_column("odd", "id % 2").groupby("odd").agg({"age": "spread"})) == [{"odd": 0, "age": 3}, {"odd": 1, "age": 13}]
    session.register_function("wrong", lambda a: "x", "bigint")
    with pytest.raises(Exception, match="wrong|function gave"):
        people.select("wrong(id) AS w").to_arrow()


def test_naive_timestamps_stay_naive(session):
    import datetime

    t = pa.table({"t": pa.array([datetime.datetime(2024, 1, 1)], pa.timestamp("us"))})
    df = session.from_arrow(t)
    assert dict(df.spark_frame.dtypes)["t"] == "timestamp_ntz"
    assert df.map(lambda r: {"t": r["t"]}).to_arrow().column("t").to_pylist() == [datetime.datetime(2024, 1, 1)]


def test_groups(grouped):
    assert rows(grouped.groupby("group").sum("val")) == [{"group": "a", "val": 6}, {"group": "b", "val": 15}]
    assert rows(grouped.groupby("group").count()) == [{"group": "a", "count": 3}, {"group": "b", "count": 3}]
    assert rows(grouped.groupby("group", n_partitions=2).agg({"val": "max"})) == [{"group": "a", "val": 3}, {"group": "b", "val": 8}]
    assert rows(grouped.groupby().agg({"val": "mean"})) == [{"val": 3.5}]
    assert rows(grouped.groupby("group").agg({"val": ["min", "median"], "*": ["count"]}))[0] == {"group": "a", "val_min": 1, "val_median": 2.0, "rows_count": 3}
    assert rows(grouped.groupby("group").min("val")) and rows(grouped.groupby("group").mean("val"))
    for bad in ({"val": "sum(val), 1"}, {"val": 3}, {}, {"*": "sum"}):
        with pytest.raises(ValueError):
            grouped.groupby("group").agg(bad)


def test_null_keys(session):
    df = session.from_arrow(pa.table({"k": ["a", None, None], "v": [1, 2, 3]}))
    assert rows(df.groupby("k").sum("v")) == [{"k": "a", "v": 1}, {"k": None, "v": 5}]
    assert df.join(df.select("k", "v AS w"), "k").count() == 1


def test_partial_sums(grouped):
    text = grouped.groupby("group").sum("val").explain("physical")
    assert "partial_sum" in text and text.count("Exchange") == 1 or "RoundRobin" in text


@pytest.fixture
def sides(session):
    a = session.from_arrow(pa.table({"id": [1, 2, 3], "v": [10, 20, 30]}))
    b = session.from_arrow(pa.table({"id": [2, 3, 4], "v": [200, 300, 400], "w": [1, 2, 3]}))
    return a, b


def test_joins(sides):
    a, b = sides
    assert rows(a.join(b, "id")) == [{"id": 2, "v": 20, "v_right": 200, "w": 1}, {"id": 3, "v": 30, "v_right": 300, "w": 2}]
    assert rows(a.join(b, "id", "left"))[0] == {"id": 1, "v": 10, "v_right": None, "w": None}
    assert {r["id"] for r in rows(a.join(b, "id", "right"))} == {2, 3, 4}
    assert {r["id"] for r in rows(a.join(b, ["id"], "outer"))} == {1, 2, 3, 4}
    assert rows(a.join(b, "id", "semi")) == [{"id": 2, "v": 20}, {"id": 3, "v": 30}] and rows(a.join(b, "id", "anti")) == [{"id": 1, "v": 10}]
    assert a.join(b, "id", right_suffix="_b").columns == ["id", "v", "v_b", "w"]
    assert a.join(b, "id").select("v + w AS x").filter("x > 30").count() == 1
    assert a.join(b, left_on="id", right_on="w").columns == ["id", "v", "id_right", "v_right", "w"]
    assert a.join(a, "id").count() == 3
    assert "BroadcastHashJoin" in a.join(b, "id", broadcast=True).explain("physical")
    assert a.join(b, "id", partition_spec=HashPartitionSpec(["id"], 3)).count() == 2
    for how in ("cross", "INNER", ""):
        with pytest.raises(ValueError):
            a.join(b, "id", how)
    with pytest.raises(ValueError):
        a.join(b)
    with pytest.raises(ValueError, match="no column"):
        a.join(b, "w")


def test_large_sides_are_not_broadcast(session, monkeypatch):
    a = session.read_parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey")
    b = session.read_parquet("/root/testdata/sf0.001/customer.parquet").select("c_custkey AS o_custkey", "c_name")
    before = session.spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    session.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = a.join(b, "o_custkey", broadcast=True).count()
        assert "BroadcastHashJoin" in a.join(b, "o_custkey", strategy="broadcast").explain("physical")
        monkeypatch.setattr(joins, "BROADCAST_LIMIT", 100)
        late = a.join(b, "o_custkey", broadcast=True)
        assert "BroadcastHashJoin" not in late.explain("physical") and late.count() == n
    finally:
        session.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keys_of_other_types(session):
    a, b = session.from_arrow(pa.table({"k": [1, 2]})), session.from_arrow(pa.table({"k": [1.0, 3.0], "x": [1, 2]}))
    assert a.join(b, "k").count() == 1


def test_asof_and_range(session):
    a = session.from_arrow(pa.table({"t": [1, 5, 9, None], "k": ["a", "a", "b", "a"]}))
    b = session.from_arrow(pa.table({"t": [0, 4, 9, 10], "k": ["a", "a", "b", None], "p": [1, 2, 3, 4]}))
    assert [(r["t"], r["t_right"], r["p"]) for r in sorted(a.join_asof(b, "t", "k").to_arrow().to_pylist(), key=lambda r: (r["t"] is None, r["t"] or 0))] == [(1, 0, 1), (5, 4, 2), (9, 9, 3), (None, None, None)]
    iv = session.from_arrow(pa.table({"lo": [0, 4, 100], "hi": [2, 9, 100], "n": [1, 2, 3]}))
    got = a.select("t").join_range(iv, "t", "lo", "hi", 5.0)
    assert sorted((r["t"], r["n"]) for r in got.to_arrow().to_pylist()) == [(1, 1), (5, 2)]


def slow_asof(a, b, by):
    out = []
    for x in a:
        found = [y for y in b if x["t"] is not None and y["t"] is not None and y["t"] <= x["t"] and (not by or (x["k"] is not None and x["k"] == y["k"]))]
        out.append((x["n"], max(found, key=lambda y: (y["t"], y["p"]))["p"] if found else None))
    return sorted(out)


@pytest.mark.parametrize("by, slices", [(None, None), (None, 7), (None, 1), ("k", None), ("k", 5)])
def test_asof_in_slices(session, by, slices):
    import random

    rng = random.Random(3)
    # most rows have one key; times repeat, and some are missing
    a = [{"n": i, "t": rng.choice([None, *range(40)]), "k": rng.choice(["hot"] * 8 + ["x", "y", None])} for i in range(150)]
    b = [{"t": rng.choice([None, *range(5, 30)]), "k": rng.choice(["hot"] * 8 + ["x", None]), "p": i} for i in range(60)]
    types = {"n": pa.int64(), "t": pa.int64(), "k": pa.string(), "p": pa.int64()}
    frame = lambda rows: session.from_arrow(pa.Table.from_pylist(rows, schema=pa.schema([(c, types[c]) for c in rows[0]])), n_partitions=3)
    right = frame(b) if by else frame(b).drop("k")
    got = frame(a).join_asof(right, "t", by, slices=slices)
    assert sorted((r["n"], r["p"]) for r in got.to_arrow().to_pylist()) == slow_asof(a, b, by)
    if by is None and slices != 1:
        assert "SinglePartition" not in "".join(x for x in got.explain("physical").split("\n") if "__side" in x and "Exchange" in x)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_ranges_of_all_lengths(session, how):
    points = session.from_arrow(pa.table({"p": [0.0, 1.5, 7.0, 99.0, 5000.0, -3.0, None]}))
    lo, hi = [0.0, 1.0, -1e9, 50.0, 3.0, 9.0], [1.0, 2.0, 1e9, 6000.0, 3.0, 4.0]
    spans = session.from_arrow(pa.table({"lo": lo, "hi": hi, "n": list(range(6))}))
    got = points.join_range(spans, "p", "lo", "hi", 1.0, how)
    want = [(p, n) for p in (0.0, 1.5, 7.0, 99.0, 5000.0, -3.0) for n in range(6) if lo[n] <= p < hi[n]] + ([(None, None)] if how == "left" else [])
    assert sorted(((r["p"], r["n"]) for r in got.to_arrow().to_pylist()), key=str) == sorted(want, key=str)
    none = points.join_range(spans.filter("n < 0"), "p", "lo", "hi", 1.0, how)
    assert none.count() == (7 if how == "left" else 0)


def test_left_ranges_sort_no_hits(session):
    """Rows without an interval are found beside the hits, not by a window over all of them; points of one file are dealt out."""
    points = session.from_arrow(pa.table({"p": [0.5, 0.5, None, 7.0, -0.0, 0.0], "x": [1, 1, 2, 3, 4, 5]}), n_partitions=1)
    spans = session.from_arrow(pa.table({"p": [0.0, 0.0], "hi": [1.0, 1e6]}))
    got = points.join_range(spans.select("p AS lo", "hi"), "p", "lo", "hi", 1.0, "left")
    assert sorted((r["x"], r["hi"] or 0) for r in got.to_arrow().to_pylist()) == sorted([(1, 1.0), (1, 1e6)] * 2 + [(4, 1.0), (4, 1e6), (5, 1.0), (5, 1e6), (3, 1e6), (2, 0)])
    plan = got.explain("physical")
    assert "Window" not in plan and "RoundRobinPartitioning" in plan


def test_names_with_dots(session):
    a = session.from_arrow(pa.table({"a.b": [1, 2], "c": [3, 4]}))
    b = session.from_arrow(pa.table({"a.b": [2], "d.e": [5]}))
    assert a.join(b, "a.b", "semi").to_arrow().to_pylist() == [{"a.b": 2, "c": 4}] and a.join(b, "a.b", "anti").count() == 1
    assert a.join(b, "a.b").to_arrow().to_pylist() == [{"a.b": 2, "c": 4, "d.e": 5}]
    assert a.join_asof(b, "a.b").columns == ["a.b", "c", "a.b_right", "d.e"]


def test_cross_join_offset_and_windows(session, people):
    two = session.from_arrow(pa.table({"x": [1, 2]}))
    assert people.cross_join(two).count() == 10
    with pytest.raises(ValueError, match="both sides"):
        people.cross_join(people)
    assert people.sort("id").offset(3).to_arrow().column("id").to_pylist() == [4, 5]
    w = people.with_column("odd", "id % 2").with_window("r", "rank()", "odd", "-age").with_window("before", "sum(age)", "odd", "id", rows=(None, -1)).with_window("near", "count(1)", "odd", "age", range_=(-5, 5))
    assert [(r["id"], r["r"], r["before"], r["near"]) for r in rows(w.select("id", "r", "before", "near"))] == [(1, 2, None, 2), (2, 2, None, 2), (3, 1, 30, 2), (4, 1, 25, 2), (5, 3, 65, 1)]
    with pytest.raises(ValueError):
        people.with_window("r", "rank()", order_by="id", rows=(0, 0), range_=(0, 0))


def test_ranges_as_partitions(session):
    df = session.from_arrow(pa.table({"a": list(range(100))}))
    p = df.repartition(partition_spec=RangePartitionSpec(["-a"], 4)).spark_frame.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).orderBy("p").collect()
    assert len(p) == 4 and all(x["lo"] > y["hi"] for x, y in zip(p, p[1:], strict=False))
    with pytest.raises(ValueError):
        df.repartition(partition_spec=RangePartitionSpec())


def test_partitions(session):
    df = session.from_arrow(pa.table({"a": list(range(100)), "key": [str(i % 7) for i in range(100)]}))
    assert df.repartition(4).n_partitions == 4
    h = df.repartition(3, partition_by="key").spark_frame.withColumn("p", F.spark_partition_id())
    assert h.groupBy("key").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    u = df.repartition(partition_spec=UserDefinedPartitionSpec(lambda b: pa.array([i % 5 for i in b.column("a").to_pylist()]), 3))
    assert u.count() == 100 and u.n_partitions == 3 and u.columns == ["a", "key"]
    assert u.filter("a < 0").repartition(partition_spec=UserDefinedPartitionSpec(lambda b: [], 2)).count() == 0
    with pytest.raises(NotImplementedError):
        df.repartition(partition_spec=object())
    with pytest.raises(ValueError):
        df.repartition(2, partition_by="key", partition_spec=HashPartitionSpec(["key"], 2))


def test_sql(people, session):
    assert people.sql("SELECT 'this' AS t, max(score) AS m FROM this").to_arrow().to_pylist() == [{"t": "this", "m": 5.5}]
    assert people.repartition(3).sql("SELECT id FROM this ORDER BY score DESC LIMIT 2").to_arrow().column("id").to_pylist() == [5, 4]
    other = session.from_arrow(pa.table({"id": [1], "x": ["y"]}))
    assert session.sql("SELECT p.name, o.x FROM p JOIN o ON p.id = o.id", p=people, o=other).to_arrow().to_pylist() == [{"name": "a", "x": "y"}]
    assert not session.spark.catalog.tableExists("p")
    with pytest.raises(ValueError):
        session.sql("SELECT 1")
    with pytest.raises(ValueError, match="ASOF"):
        session.sql("SELECT * FROM p ASOF JOIN o", p=people, o=other)
    assert check_dialect("SELECT 'a asof join b'")
    with pytest.raises(ValueError):
        aggregate_column("a", "f(x)")


def test_views_of_the_caller_come_back(people, session):
    session.spark.range(3).createOrReplaceTempView("p")
    session.sql("SELECT * FROM p", p=people)
    assert session.spark.table("p").count() == 3
    session.spark.catalog.dropTempView("p")


def test_sets_and_order(people, session):
    more = session.from_arrow(pa.table({"id": [5, 6]}))
    ids = people.select("id")
    assert ids.union(more).count() == 7 and ids.union(more, distinct=True).count() == 6
    assert ids.intersect(more).count() == 1 and ids.difference(more).count() == 4
    assert people.top_k(2, "-score").select("id").to_arrow().column("id").to_pylist() == [5, 4]
    assert people.sort("-age").to_arrow().column("age").to_pylist()[0] == 35
    assert people.with_column("g", "id % 2").top_k(1, "-score", per="g").count() == 2
    assert people.drop_duplicates(["name"]).distinct().count() == 5 and people.sample(1.0, 3).count() == 5


def test_compute_and_show(people, capsys):
    kept = people.filter("id > 1").compute()
    assert kept.count() == 4 and kept.unpersist().count() == 4
    people.show(2)
    assert capsys.readouterr().out.count("\n") == 3
    for mode in ("logical", "optimized", "physical", "formatted"):
        assert people.explain(mode)
    with pytest.raises(ValueError):
        people.explain("nonsense")


def test_files(session, tmp_path, people):
    out = str(tmp_path / "p")
    lazy = people.write_parquet(out)
    assert not (tmp_path / "p").exists()
    assert lazy.count() == 5 and lazy.count() == 5
    assert session.read_parquet(out).count() == 5  # written once
    people.write_parquet(out).compute()
    assert session.read_parquet(out).count() == 10  # files are added
    assert session.read_parquet(out + "/*.parquet", n_partitions=7).count() == 10
    assert session.parquet_schema(out).names == ["id", "name", "age", "score"]
    people.write_csv(str(tmp_path / "c"), delimiter=";", include_header=False).compute()
    assert session.read_csv(str(tmp_path / "c"), delimiter=";", has_header=False).count() == 5
    for missing in (tmp_path / "none", tmp_path / "no*"):
        with pytest.raises(ValueError, match="no parquet files"):
            session.read_parquet(str(missing))
    (tmp_path / "deep" / "a" / "b").mkdir(parents=True)
    people.spark_frame.write.parquet(str(tmp_path / "deep" / "a" / "b" / "x"))
    assert session.read_parquet(str(tmp_path / "deep")).count() == 5


def test_a_pending_write_runs_through_later_steps(session, tmp_path, people):
    people.write_parquet(str(tmp_path / "w")).filter("id = 1").count()
    assert session.read_parquet(str(tmp_path / "w")).count() == 5


def test_writes_of_both_sides_run(session, tmp_path, people):
    other = session.from_arrow(pa.table({"id": [1], "t": [5]}))
    ids = people.select("id")
    ways = {
        "union": lambda o: ids.union(o.select("id")),
        "intersect": lambda o: ids.intersect(o.select("id")),
        "difference": lambda o: ids.difference(o.select("id")),
        "asof": lambda o: ids.join_asof(o, "id"),
        "range": lambda o: ids.join_range(o.select("id AS lo", "t AS hi"), "id", "lo", "hi", 4.0),
        "cross": lambda o: ids.cross_join(o.rename({"id": "id2"})),
        "join": lambda o: ids.join(o, "id"),
        "sql": lambda o: session.sql("SELECT * FROM a JOIN b USING (id)", a=ids, b=o),
    }
    for name, way in ways.items():
        path = tmp_path / name
        way(other.write_parquet(str(path))).count()
        assert session.read_parquet(str(path)).count() == 1, name


def test_writes_run_once(session, tmp_path, people):
    one = people.write_parquet(str(tmp_path / "a"))
    two = one.write_parquet(str(tmp_path / "b"))
    assert one.count() == two.count() == 5
    assert session.read_parquet(str(tmp_path / "a")).count() == session.read_parquet(str(tmp_path / "b")).count() == 5


def test_other_formats(session, tmp_path, people):
    people.write_orc(str(tmp_path / "o"), partition_cols=["name"]).compute()
    assert rows(session.read_orc(str(tmp_path / "o")).select(*people.columns)) == rows(people)
    people.write_json(str(tmp_path / "j")).compute()
    assert rows(session.read_json(str(tmp_path / "j")).select(*people.columns)) == rows(people)
    assert session.read_json(str(tmp_path / "j"), schema="id long").columns == ["id"]
    with pytest.raises(ConnectorMissing):
        session.read_jdbc("jdbc:none://x", "t")
    with pytest.raises(ValueError, match="bounds"):
        session.read_jdbc("jdbc:none://x", "t", column="a")


def test_mixed_folders(session, tmp_path, people):
    people.spark_frame.write.parquet(str(tmp_path / "m" / "k=1"))
    people.spark_frame.write.parquet(str(tmp_path / "m" / "deep" / "er"))
    with pytest.raises(ValueError, match="side by side"):
        session.read_parquet(str(tmp_path / "m"))


def test_hive(session, tmp_path):
    df = session.from_arrow(pa.table({"id": [1, 2, 3, 4], "year": [2023, 2024, 2024, None], "region": ["us", "eu", "us", "us"]}))
    path = str(tmp_path / "h")
    df.write_parquet(path, partition_cols=["year", "region"], n_partitions=2, compression="zstd").compute()
    back = session.read_parquet(path)
    assert rows(back.select("id", "year", "region")) == rows(df) and (tmp_path / "h" / "year=2024" / "region=us").is_dir()
    pruned = back.filter("year = 2024 AND id > 0")
    assert pruned.count() == 2 and "PartitionFilters: [isnotnull(year" in pruned.explain("formatted")


def test_pushdown(session):
    df = session.read_parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity > 45").select("l_orderkey")
    text = df.explain("formatted")
    assert "GreaterThan(l_quantity,45.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_places_of_files():
    assert uri("s3://b/x") == "s3a://b/x" and uri("b/x", "gcs") == "gs://b/x" and uri("/x") == "/x" and uri("az://c/x") == "abfss://c/x"


def test_missing_connectors(session):
    for read in (lambda: session.read_delta("/tmp/x", version=1), lambda: session.read_kafka("t", "h:1"), lambda: session.read_kafka_stream("t", "h:1", "a int")):
        with pytest.raises(ConnectorMissing):
            read()


def test_telemetry(session, tmp_path):
    seen = []
    token = session.on_job_event(lambda e: seen.append(e.kind))
    session.on_job_event(lambda e: 1 / 0)  # goes no further
    session.enable_telemetry(str(tmp_path / "log"))
    df = session.from_arrow(pa.table({"a": [1, 2]}))
    assert df.count() == 2
    assert seen == ["task.started", "task.finished"] and session.telemetry_summary()["rows_out"] == 2
    with pytest.raises(Exception):
        df.map(lambda r: {"a": 1 // 0}, output_schema=df.schema).count()
    assert seen[-1] == "task.failed"
    session.disable_telemetry()
    assert len((tmp_path / "log").read_text().splitlines()) == 4
    assert session.observer.unsubscribe(token) and not session.observer.unsubscribe(token)
    session.observer.reset()
    assert session.telemetry_summary()["events"] == {}


def test_stages_of_a_task(session):
    seen = []
    session.on_job_event(seen.append)
    session.from_spark(session.spark.range(0, 100, 1, 3)).groupby().agg({"id": "sum"}).to_arrow()
    stages = seen[-1].extra["stages"]
    assert seen[0].extra == {"status": "running"} and seen[-1].extra["status"] == "finished"
    assert any(x["partitions"] == 3 and x["done"] == 3 and not x["failed"] for x in stages) and len({x["stage_id"] for x in stages}) == len(stages)
    with pytest.raises(Exception):
        session.from_spark(session.spark.range(2)).map(lambda r: {"a": 1 // 0}, output_schema="a int").to_arrow()
    assert seen[-1].extra["status"] == "failed" and any(x["failed"] for x in seen[-1].extra["stages"])
    assert session.spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_sessions(spark):
    with Session(spark=spark) as s:
        assert s in GlobalContext.get().sessions() and "own=False" in repr(s)
        assert s.scheduler is spark.sparkContext
    assert s not in GlobalContext.sessions() and spark.range(1).count() == 1  # a session that is given goes on
    s.stop()
    GlobalContext.stop_all()
    GlobalContext.reset()
