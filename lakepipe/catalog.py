"""The registered queries of the dataframe API and, where SQL can say the same, that SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakepipe import shared
from lakepipe.frame import DataFrame
from lakepipe.operators.partitioning import RangePartitionSpec, UserDefinedPartitionSpec
from lakepipe.session import Session

QUERIES: dict[str, Callable[[SparkSession, str], SparkFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder, as frames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.session, self.dir = Session(spark=spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.session.read_parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables that gives a DataFrame (or a Spark frame)."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> SparkFrame:
            out = fn(Tables(spark, sf_dir))
            return out.spark_frame if isinstance(out, DataFrame) else out

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register




# ---- scans, filters, projections


@query("SELECT r_regionkey, r_name FROM region")
def scan_parquet(t):
    return t.region


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_sql(t):
    return t.lineitem.filter("l_quantity > 45 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus != 'F'")
def filter_callable(t):
    return t.orders.select("o_orderkey", "o_orderstatus").filter(lambda r: r["o_orderkey"] % 7 == 0 and r["o_orderstatus"] != "F")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_tax < 0.02 AND l_quantity < 10")
def filter_fused(t):
    return t.lineitem.filter("l_discount > 0.05").filter("l_tax < 0.02").filter("l_quantity < 10").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_cols(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, CAST(l_quantity AS BIGINT) AS qty FROM lineitem")
def select_expr(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice * (1 - l_discount) AS revenue", "cast(l_quantity AS bigint) AS qty")


@query("SELECT o_orderkey, double_key FROM (SELECT o_orderkey, o_orderkey * 2 AS double_key FROM orders) WHERE double_key > 1000")
def select_chain_alias(t):
    return t.orders.select("o_orderkey", "o_orderkey * 2 AS double_key").select("o_orderkey", "double_key").filter("double_key > 1000")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 100)")
def limit_count(t):
    return t.orders.limit(100).groupby().agg({"*": "count"}).rename({"count": "n"})


@query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal, upper(c_mktsegment) AS segment FROM customer")
def column_ops(t):
    return t.customer.with_column("c_acctbal", "c_acctbal + 1").with_column("c_mktsegment", "upper(c_mktsegment)").rename({"c_mktsegment": "segment"}).drop("c_name", "c_nationkey")


# ---- aggregates


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY l_returnflag")
def group_sum(t):
    return t.lineitem.groupby("l_returnflag").sum("l_quantity").select("l_returnflag", "round(l_quantity, 2) AS l_quantity")


@query("SELECT l_linestatus, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def group_mean(t):
    return t.lineitem.groupby("l_linestatus").mean("l_discount", "l_tax").select("l_linestatus", "round(l_discount, 6) AS l_discount", "round(l_tax, 6) AS l_tax")


@query("SELECT o_orderpriority, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM orders GROUP BY 1")
def group_min_max(t):
    return t.orders.groupby("o_orderpriority").agg({"o_totalprice": ["min", "max"]})


@query("SELECT o_orderstatus, count(*) AS \"count\" FROM orders GROUP BY 1")
def group_count(t):
    return t.orders.groupby("o_orderstatus").count()


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2")
def group_multi_key(t):
    df = t.lineitem.filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").with_column("disc_price", "l_extendedprice * (1 - l_discount)")
    out = df.groupby("l_returnflag", "l_linestatus").agg({"l_quantity": "sum", "l_extendedprice": "sum", "disc_price": "sum", "l_discount": "mean", "*": "count"})
    return out.select("l_returnflag", "l_linestatus", "round(l_quantity, 2) AS sum_qty", "round(l_extendedprice, 2) AS sum_base", "round(disc_price, 2) AS sum_disc", "round(l_discount, 6) AS avg_disc", "`count` AS n")


@query("SELECT l_suppkey, count(*) AS \"count\" FROM lineitem GROUP BY 1")
def group_n_partitions(t):
    return t.lineitem.groupby("l_suppkey", n_partitions=4).count()


@query("SELECT round(sum(l_quantity), 2) AS q, round(max(l_extendedprice), 2) AS p FROM lineitem")
def global_agg(t):
    return t.lineitem.groupby().agg({"l_quantity": "sum", "l_extendedprice": "max"}).select("round(l_quantity, 2) AS q", "round(l_extendedprice, 2) AS p")


@query("SELECT o_orderstatus, round(median(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY 1")
def agg_median(t):
    return t.orders.groupby("o_orderstatus").agg({"o_totalprice": "median"}).select("o_orderstatus", "round(o_totalprice, 4) AS o_totalprice")


@query("SELECT o_orderstatus, round(stddev(o_totalprice), 3) AS sd, round(var_pop(o_totalprice), 0) AS vp FROM orders GROUP BY 1")
def agg_stddev(t):
    return t.orders.groupby("o_orderstatus").agg({"o_totalprice": ["stddev", "var_pop"]}).select("o_orderstatus", "round(o_totalprice_stddev, 3) AS sd", "round(o_totalprice_var_pop, 0) AS vp")


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def agg_count_distinct(t):
    return t.lineitem.groupby("l_returnflag").agg({"l_partkey": "count_distinct"})


@query("SELECT l_returnflag, bool_and(big) AS big_bool_and, bool_or(big) AS big_bool_or FROM (SELECT l_returnflag, l_quantity > 49 AS big FROM lineitem) GROUP BY 1")
def agg_bool(t):
    return t.lineitem.select("l_returnflag", "l_quantity > 49 AS big").groupby("l_returnflag").agg({"big": ["bool_and", "bool_or"]})


@query("SELECT l_returnflag, l_linestatus, count(*) AS \"count\" FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").count()


@query("SELECT l_returnflag, l_linestatus, count(*) AS \"count\" FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").count()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def agg_grouping_sets(t):
    return t.orders.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM this GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def agg_having(t):
    return t.orders.groupby("o_custkey").count().filter("`count` > 12").rename({"count": "n"})


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) FILTER (WHERE l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def agg_pivot(t):
    return t.lineitem.groupby("l_returnflag").pivot("l_linestatus", ["O", "F"], {"*": "count"}).fill_null(0)


@query("SELECT o_orderpriority, mode(o_orderstatus) AS o_orderstatus FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 5 < 3 THEN 'x' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def agg_mode(t):
    return t.orders.select("o_orderpriority", "CASE WHEN o_orderkey % 5 < 3 THEN 'x' ELSE o_orderstatus END AS o_orderstatus").groupby("o_orderpriority").agg({"o_orderstatus": "mode"})


@query("SELECT n_regionkey, list_sort(list(n_name)) AS names, len(list(n_nationkey)) AS n FROM nation GROUP BY 1")
def agg_lists(t):
    return t.nation.groupby("n_regionkey").agg({"n_name": ["list"], "n_nationkey": ["array_agg"]}).select("n_regionkey", "array_sort(n_name_list) AS names", "cast(size(n_nationkey_array_agg) AS bigint) AS n")


@query("SELECT n_regionkey, len(string_agg(n_name, '')) AS chars FROM nation GROUP BY 1")
def agg_string(t):
    return t.nation.groupby("n_regionkey").agg({"n_name": "string_agg"}).select("n_regionkey", "cast(length(n_name) AS bigint) AS chars")


@query("SELECT o_orderstatus, count(o_totalprice) AS c, round(avg(o_totalprice), 3) AS a, round(stddev_pop(o_totalprice), 2) AS sd, round(var_samp(o_totalprice), 0) AS v, round(skewness(o_totalprice), 2) AS sk FROM orders GROUP BY 1")
def agg_moments(t):
    out = t.orders.groupby("o_orderstatus").agg({"o_totalprice": ["count", "mean", "stddev_pop", "var_samp"]})
    # the sample's skewness, from that of the population
    sk = t.orders.groupby("o_orderstatus").agg({"o_totalprice": ["skewness", "count"]}).select("o_orderstatus", "round(o_totalprice_skewness * sqrt(o_totalprice_count * (o_totalprice_count - 1)) / (o_totalprice_count - 2), 2) AS sk")
    return out.select("o_orderstatus", "o_totalprice_count AS c", "round(o_totalprice_mean, 3) AS a", "round(o_totalprice_stddev_pop, 2) AS sd", "round(o_totalprice_var_samp, 0) AS v").join(sk, "o_orderstatus")


@query("SELECT o_orderpriority, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def agg_first_last(t):
    """Of sorted rows, by value: first and last of an order are the ends of what min_by and max_by see."""
    return t.orders.sql("SELECT o_orderpriority, min_by(o_orderkey, o_orderkey) AS first_key, max_by(o_orderkey, o_orderkey) AS last_key FROM this GROUP BY 1")


@query("SELECT l_returnflag, abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) < 0.2 * count(DISTINCT l_orderkey) AS near FROM lineitem GROUP BY 1")
def agg_approx_distinct(t):
    out = t.lineitem.groupby("l_returnflag").agg({"l_orderkey": ["approx_count_distinct", "count_distinct"]})
    return out.select("l_returnflag", "abs(l_orderkey_approx_count_distinct - l_orderkey_count_distinct) < 0.2 * l_orderkey_count_distinct AS near")


@query("SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)")
def agg_cube_sum(t):
    return t.customer.cube("c_nationkey", "c_mktsegment").sum("c_acctbal").select("c_nationkey", "c_mktsegment", "round(c_acctbal, 2) AS c_acctbal")


# ---- joins


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey AS o_custkey", "c_name"), "o_custkey").select("o_orderkey", "o_custkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(t):
    return t.customer.select("c_custkey").join(t.orders.select("o_custkey AS c_custkey", "o_orderkey"), "c_custkey", "left")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(t):
    return t.orders.select("o_custkey AS c_custkey", "o_orderkey").join(t.customer.select("c_custkey"), "c_custkey", "right")


@query("SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a FULL JOIN (SELECT r_regionkey + 20 AS k, r_name AS y FROM region) b ON a.k = b.k")
def join_outer(t):
    return t.nation.select("n_nationkey AS k", "n_name AS x").join(t.region.select("r_regionkey + 20 AS k", "r_name AS y"), "k", "outer")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t):
    return t.customer.select("c_custkey", "c_name").join(t.orders.filter("o_totalprice > 300000").select("o_custkey AS c_custkey", "o_totalprice"), "c_custkey", "semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(t):
    return t.customer.select("c_custkey", "c_name").join(t.orders.filter("o_totalprice > 300000").select("o_custkey AS c_custkey", "o_totalprice"), "c_custkey", "anti")


@query("SELECT a.l_partkey, a.l_suppkey, a.n, b.q FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_partkey, l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_multi_key(t):
    a = t.lineitem.groupby("l_partkey", "l_suppkey").count().rename({"count": "n"})
    b = t.lineitem.filter("l_returnflag = 'R'").groupby("l_partkey", "l_suppkey").sum("l_quantity").select("l_partkey", "l_suppkey", "round(l_quantity, 2) AS q")
    return a.join(b, ["l_partkey", "l_suppkey"])


@query("SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def join_suffix(t):
    return t.nation.select("n_nationkey", "n_name").join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(t):
    return t.supplier.join(t.nation, left_on="s_nationkey", right_on="n_nationkey", broadcast=True).select("s_suppkey", "s_name", "n_name")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40")
def join_shuffle_hash(t):
    return t.lineitem.filter("l_quantity > 40").join(t.orders, left_on="l_orderkey", right_on="o_orderkey", strategy="shuffle_hash").select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("SELECT n_name, r_name, n_nationkey + 1 AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def join_then_select(t):
    return t.nation.join(t.region, left_on="n_regionkey", right_on="r_regionkey").select("n_name", "r_name", "n_nationkey + 1 AS k").filter("r_name LIKE 'A%'")


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta_sql(t):
    return t.session.sql("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM a JOIN b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", a=t.nation, b=t.nation)


@query("SELECT event_id, max(prev) AS last_view FROM (SELECT a.event_id, b.event_id AS prev, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts <= a.ts WHERE a.event_type = 'purchase') WHERE n = 1 GROUP BY event_id")
def join_asof(t):
    buys = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = t.events.filter("event_type = 'view'").select("user_id", "ts", "event_id AS last_view")
    return buys.join_asof(views, "ts", "user_id").select("event_id", "last_view")


@query("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal AS a, s_acctbal + 50 AS b FROM supplier) ON p_retailprice >= a AND p_retailprice < b")
def join_range(t):
    return t.part.select("p_partkey", "p_retailprice").join_range(t.supplier.select("s_suppkey", "s_acctbal AS a", "s_acctbal + 50 AS b"), "p_retailprice", "a", "b", 50.0).select("p_partkey", "s_suppkey")


@query("SELECT event_id, last_view FROM (SELECT a.event_id, b.event_id AS last_view, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS n FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON b.ts <= a.ts) WHERE n = 1")
def join_asof_all(t):
    """Without a key: ranges of time are dealt to the tasks."""
    buys = t.events.filter("event_type = 'purchase'").select("event_id", "ts")
    views = t.events.filter("event_type = 'view'").select("ts", "event_id AS last_view")
    return buys.join_asof(views, "ts").select("event_id", "last_view")


@query("SELECT p_partkey, s_suppkey FROM part LEFT JOIN (SELECT s_suppkey, s_acctbal AS a, s_acctbal + s_suppkey * s_suppkey / 10 AS b FROM supplier) ON p_retailprice >= a AND p_retailprice < b")
def join_range_left(t):
    """Intervals of very different lengths."""
    return t.part.select("p_partkey", "p_retailprice").join_range(t.supplier.select("s_suppkey", "s_acctbal AS a", "s_acctbal + s_suppkey * s_suppkey / 10 AS b"), "p_retailprice", "a", "b", 5.0, "left").select("p_partkey", "s_suppkey")


@query("SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
def join_cross(t):
    return t.nation.select("n_nationkey").cross_join(t.region.select("r_regionkey"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_merge(t):
    return t.orders.filter("o_totalprice > 200000").join(t.customer, left_on="o_custkey", right_on="c_custkey", strategy="merge").select("o_orderkey", "c_name")


# ---- Python functions


@query("SELECT o_orderkey, o_totalprice * 2 AS double_price FROM orders")
def map_row(t):
    return t.orders.select("o_orderkey", "o_totalprice").map(lambda r: {"o_orderkey": r["o_orderkey"], "double_price": r["o_totalprice"] * 2})


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL")
def flatmap_rows(t):
    return t.documents.select("doc_id", "text").flatmap(lambda r: [{"doc_id": r["doc_id"], "line": x} for x in (r["text"].split("\n") if r["text"] is not None else [])], output_schema=pa.schema([("doc_id", pa.int64()), ("line", pa.string())]))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def map_batches(t):
    def revenue(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"l_orderkey": b["l_orderkey"], "l_linenumber": b["l_linenumber"], "revenue": pc.multiply(b["l_extendedprice"], pc.subtract(1.0, b["l_discount"]))})

    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount").map_batches(revenue, batch_size=4096)


@query("SELECT c_custkey, c_nationkey * 2 + 1 AS odd, c_acctbal / 2 AS half FROM customer")
def functions_in_sql(t):
    """Functions by value and of Arrow arrays, registered for SQL."""
    t.session.register_function("lp_odd", lambda k: 2 * k + 1, "int")
    t.session.register_function("lp_half", lambda x: pc.divide(x, 2.0), "double", vectorized=True)
    return t.customer.select("c_custkey", "lp_odd(c_nationkey) AS odd", "lp_half(c_acctbal) AS half")


@query("SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS c_acctbal FROM customer GROUP BY 1")
def aggregate_in_python(t):
    t.session.register_aggregate("lp_spread", lambda x: pc.max(x).as_py() - pc.min(x).as_py(), "double")
    return t.customer.groupby("c_nationkey").agg({"c_acctbal": "lp_spread"})


# ---- partitions


@query("SELECT CAST(6 AS BIGINT) AS parts, count(*) AS n FROM orders")
def repartition_even(t):
    df = t.orders.repartition(6).spark_frame.withColumn("p", F.spark_partition_id())
    return df.agg(F.count_distinct("p").alias("parts"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, CAST(1 AS BIGINT) AS parts FROM orders GROUP BY 1")
def repartition_hash(t):
    df = t.orders.repartition(5, partition_by="o_custkey").spark_frame.withColumn("p", F.spark_partition_id())
    return df.groupBy("o_custkey").agg(F.count_distinct("p").alias("parts"))


@query("SELECT CAST(o_orderkey % 3 AS INTEGER) AS p, count(*) AS n FROM orders GROUP BY 1")
def repartition_user(t):
    spec = UserDefinedPartitionSpec(lambda b: [k % 3 for k in b.column("o_orderkey").to_pylist()], 3)
    df = t.orders.select("o_orderkey").repartition(partition_spec=spec).spark_frame.withColumn("p", F.spark_partition_id())
    return df.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# ---- order, windows, sets, SQL


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").top_k(10, ["-o_totalprice", "o_orderkey"])


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_k_per_group(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").top_k(3, ["-o_totalprice", "o_orderkey"], per="o_orderpriority")


@query("SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
def window_rank(t):
    return t.customer.sql("SELECT c_custkey, cast(rank() OVER w AS bigint) AS r, cast(dense_rank() OVER w AS bigint) AS d, cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS bigint) AS n, cast(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS bigint) AS q FROM this WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")


@query("SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_lag_lead(t):
    order = {"partition_by": "user_id", "order_by": ["ts", "event_id"]}
    df = t.events.select("event_id", "user_id", "ts")
    for name, function in (("previous", "lag(event_id)"), ("next", "lead(event_id)"), ("first", "first_value(event_id)")):
        df = df.with_window(name, function, **order)
    return df.select("event_id", "previous", "next", "first")


@query("SELECT o_orderkey, nth_value(o_orderkey, 2) OVER w AS second, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)")
def window_distribution(t):
    df = t.orders
    for name, function in (("second", "nth_value(o_orderkey, 2)"), ("p", "percent_rank()"), ("c", "cume_dist()")):
        df = df.with_window(name, function, "o_orderpriority", "o_orderkey")
    return df.select("o_orderkey", "second", "round(p, 9) AS p", "round(c, 9) AS c")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders")
def window_running_sum(t):
    df = t.orders.with_window("running", "sum(o_totalprice)", "o_custkey", ["o_orderdate", "o_orderkey"], rows=(None, 0)).with_window("near", "count(1)", "o_custkey", ["o_orderdate", "o_orderkey"], rows=(-2, 0))
    return df.select("o_orderkey", "round(running, 2) AS running", "near")


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM customer")
def window_range(t):
    return t.customer.with_window("near", "count(1)", "c_nationkey", "c_acctbal", range_=(-100, 100)).select("c_custkey", "near")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 1400")
def sort_offset(t):
    return t.orders.sort("o_totalprice", "o_orderkey").offset(1400).select("o_orderkey")


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_all(t):
    return t.nation.select("n_nationkey AS k").union(t.region.select("r_regionkey AS k"))


@query("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def union_distinct(t):
    return t.nation.select("n_nationkey AS k").union(t.region.select("r_regionkey AS k"), distinct=True)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t.customer.select("c_nationkey AS k").intersect(t.supplier.select("s_nationkey AS k"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_except(t):
    return t.customer.select("c_custkey AS k").difference(t.orders.filter("o_totalprice > 300000").select("o_custkey AS k"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(t):
    return t.customer.select("c_nationkey AS k").difference(t.supplier.select("s_nationkey AS k"), all=True)


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(t):
    return t.part.select("p_brand", "p_size").distinct()


@query("SELECT s_suppkey, variable, value FROM (SELECT s_suppkey, 'nation' AS variable, CAST(s_nationkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 'acctbal', s_acctbal FROM supplier)")
def unpivot(t):
    return t.supplier.select("s_suppkey", "cast(s_nationkey AS double) AS nation", "s_acctbal AS acctbal").unpivot(["s_suppkey"], ["nation", "acctbal"])


@query("SELECT c_mktsegment, count(*) AS n, round(max(c_acctbal), 2) AS best FROM customer GROUP BY 1 ORDER BY n DESC")
def sql_this(t):
    return t.customer.sql("SELECT c_mktsegment, count(*) AS n, round(max(c_acctbal), 2) AS best FROM this GROUP BY 1 ORDER BY n DESC")


@query("SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def sql_named_join(t):
    return t.session.sql("SELECT n.n_name, count(*) AS n FROM c JOIN n ON c.c_nationkey = n.n_nationkey GROUP BY 1", c=t.customer, n=t.nation)


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) SELECT o_custkey, count(*) AS n FROM big WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def sql_subqueries(t):
    return t.session.sql("WITH big AS (SELECT * FROM o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM o)) SELECT o_custkey, count(*) AS n FROM big WHERE o_custkey IN (SELECT c_custkey FROM c WHERE c_mktsegment = 'BUILDING') GROUP BY 1", o=t.orders, c=t.customer)


# ---- scalar functions


@query("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substring(c_name, 3, 4) AS s, replace(c_name, '0', 'o') AS r, concat(c_name, '-', c_mktsegment) AS cc, c_name LIKE '%1' AS ends, regexp_replace(c_name, '[0-9]+', '#', 'g') AS rx FROM customer")
def fn_string(t):
    return t.customer.select("c_custkey", "upper(c_name) AS u", "lower(c_mktsegment) AS l", "cast(length(c_name) AS bigint) AS n", "substring(c_name, 3, 4) AS s", "replace(c_name, '0', 'o') AS r", "concat(c_name, '-', c_mktsegment) AS cc", "c_name LIKE '%1' AS ends", "regexp_replace(c_name, '[0-9]+', '#') AS rx")


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def fn_date(t):
    return t.orders.select("o_orderkey", "cast(year(o_orderdate) AS bigint) AS y", "cast(month(o_orderdate) AS bigint) AS m", "date_format(trunc(cast(o_orderdate AS date), 'MM'), 'yyyy-MM-dd') AS first_day", "cast(datediff(cast(o_orderdate AS date), date'1992-01-01') AS bigint) AS days")


@query("SELECT p_partkey, round(p_retailprice, 1) AS r, floor(p_retailprice) AS f, abs(0 - p_retailprice) AS a, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, p_size % 7 AS m, round(power(p_size, 2), 2) AS p FROM part")
def fn_math(t):
    return t.part.select("p_partkey", "round(p_retailprice, 1) AS r", "cast(floor(p_retailprice) AS double) AS f", "abs(0 - p_retailprice) AS a", "round(sqrt(p_retailprice), 6) AS s", "round(ln(p_retailprice), 6) AS l", "p_size % 7 AS m", "round(power(p_size, 2), 2) AS p")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(l_returnflag, 'N'), '-') AS flag FROM lineitem")
def fn_case(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS band", "coalesce(nullif(l_returnflag, 'N'), '-') AS flag")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(t):
    return t.events.select("event_id", "cast(get_json_object(props, '$.k') AS bigint) AS k")


@query("SELECT vec_id, len(embedding) AS n, embedding[1] AS first, round(list_max(embedding), 5) AS hi, list_contains(embedding, embedding[3]) AS has FROM embeddings")
def fn_array(t):
    return t.embeddings.select("vec_id", "cast(size(embedding) AS bigint) AS n", "element_at(embedding, 1) AS first", "round(array_max(embedding), 5) AS hi", "array_contains(embedding, element_at(embedding, 3)) AS has")


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def fn_explode(t):
    return t.embeddings.select("vec_id", "embedding AS x").explode("x")


@query("SELECT n_nationkey, m['key'] AS k, CAST(cardinality(m) AS BIGINT) AS n, list_sort(map_keys(m)) AS ks, list_contains(map_keys(m), 'name') AS has FROM (SELECT n_nationkey, MAP {'key': CAST(n_nationkey AS VARCHAR), 'name': n_name} AS m FROM nation)")
def fn_map(t):
    df = t.nation.select("n_nationkey", "map('key', cast(n_nationkey AS string), 'name', n_name) AS m")
    return df.select("n_nationkey", "m['key'] AS k", "cast(size(m) AS bigint) AS n", "array_sort(map_keys(m)) AS ks", "map_contains_key(m, 'name') AS has")


@query("SELECT n_regionkey, key, value FROM (SELECT n_regionkey, unnest(map_entries(MAP {'a': n_nationkey, 'b': n_nationkey + 1}), recursive := true) FROM nation)")
def fn_map_explode(t):
    return t.nation.sql("SELECT n_regionkey, key, value FROM this LATERAL VIEW explode(map('a', n_nationkey, 'b', n_nationkey + 1)) e AS key, value")


@query("SELECT s_suppkey, {'n': s_nationkey, 'b': round(s_acctbal, 1)}.b AS b, coalesce(nullif(s_nationkey, 3), -1) AS n, greatest(s_nationkey, 5) AS g, s_acctbal BETWEEN 0 AND 5000 AS mid FROM supplier")
def fn_struct_and_null(t):
    return t.supplier.select("s_suppkey", "named_struct('n', s_nationkey, 'b', round(s_acctbal, 1)).b AS b", "coalesce(nullif(s_nationkey, 3), -1) AS n", "greatest(s_nationkey, 5) AS g", "s_acctbal BETWEEN 0 AND 5000 AS mid")


# ---- rows in memory, globs, samples


@query("SELECT n_nationkey, n_name FROM nation")
def scan_arrow(t):
    return t.session.from_arrow(t.nation.select("n_nationkey", "n_name").to_arrow(), n_partitions=3)


@query("SELECT r_regionkey, r_name FROM region")
def scan_pandas(t):
    return t.session.from_pandas(t.region.to_pandas())


@query("SELECT n_nationkey, n_name FROM nation")
def scan_glob(t):
    return t.session.read_parquet(f"{t.dir}/nat*n.parquet").select("n_nationkey", "n_name")


@query("SELECT r_name, r_regionkey FROM region")
def scan_with_schema(t):
    return t.session.read_parquet([f"{t.dir}/region.parquet"], schema="r_name string, r_regionkey int")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01 00:00:00' AND l_quantity BETWEEN 10 AND 12")
def scan_pushdown(t):
    return t.lineitem.filter("l_shipdate >= timestamp_ntz'1998-06-01 00:00:00' AND l_quantity BETWEEN 10 AND 12").select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, min(o_orderkey) IS NOT NULL AS one FROM orders GROUP BY 1")
def drop_duplicates(t):
    return t.orders.select("o_custkey", "o_orderkey").drop_duplicates(["o_custkey"]).select("o_custkey", "o_orderkey IS NOT NULL AS one")


@query("SELECT count(*) BETWEEN 1 AND 15000 AS some FROM orders")
def sample_rows(t):
    return t.orders.sample(0.5, seed=3).groupby().agg({"*": "count"}).select("`count` BETWEEN 1 AND 15000 AS some")


@query("SELECT CAST(8 AS BIGINT) AS n")
def local_limit(t):
    return t.orders.repartition(4).local_limit(2).groupby().agg({"*": "count"}).rename({"count": "n"})


@query("SELECT CAST(4 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS overlaps")
def repartition_range(t):
    parts = t.orders.select("o_orderkey").repartition(partition_spec=RangePartitionSpec(["o_orderkey"], 4)).with_column("p", "spark_partition_id()")
    ends = parts.groupby("p").agg({"o_orderkey": ["min", "max"]}).with_window("before", "max(o_orderkey_max)", order_by="p", rows=(None, -1))
    return ends.groupby().agg({"*": "count"}).rename({"count": "parts"}).cross_join(ends.filter("before >= o_orderkey_min").groupby().agg({"*": "count"}).rename({"count": "overlaps"}))


# ---- files


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(t):
    path = shared.folder(t.session.spark)
    t.nation.write_csv(path, delimiter="|").compute()
    return t.session.read_csv(path, delimiter="|")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def hive_roundtrip(t):
    path = shared.folder(t.session.spark)
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").write_parquet(path, partition_cols=["o_orderstatus"]).compute()
    return t.session.read_parquet(path)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def hive_prune(t):
    path = shared.folder(t.session.spark)
    t.orders.select("o_orderkey", "o_orderpriority").write_parquet(path, partition_cols=["o_orderpriority"], compression="zstd").compute()
    return t.session.read_parquet(path).filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "cast(o_orderpriority AS string) AS o_orderpriority")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def orc_roundtrip(t):
    path = shared.folder(t.session.spark)
    t.supplier.select("s_suppkey", "s_name", "s_nationkey").write_orc(path, partition_cols=["s_nationkey"]).compute()
    return t.session.read_orc(path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_roundtrip(t):
    path = shared.folder(t.session.spark)
    t.customer.select("c_custkey", "c_name", "c_acctbal").write_json(path).compute()
    return t.session.read_json(path, schema="c_custkey long, c_name string, c_acctbal double")


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem")
def parquet_roundtrip(t):
    path = shared.folder(t.session.spark)
    t.lineitem.write_parquet(path, compression="zstd", n_partitions=5).compute()
    return t.session.read_parquet(path).groupby().agg({"*": "count", "l_quantity": "sum"}).select("`count` AS n", "round(l_quantity, 2) AS q")


# ---- streams (over what is there, then read back)


def _events_stream(t):
    schema = t.events.schema
    return t.session.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.dir}/events.parquet*")


def _through(t, stream) -> DataFrame:
    from lakepipe.streaming import ParquetSink

    path = shared.folder(t.session.spark)
    stream.to(ParquetSink(f"{path}/out")).run(available_now=True, checkpoint=f"{path}/checkpoint")
    return t.session.read_parquet(f"{path}/out")


@query("SELECT event_id, value * 2 AS double_value FROM events WHERE event_type = 'purchase'")
def stream_filter_map(t):
    schema = pa.schema([("event_id", pa.int64()), ("double_value", pa.float64())])
    stream = t.session.read_stream(_events_stream(t)).filter("event_type = 'purchase'").select("event_id", "value").map(lambda r: {"event_id": r["event_id"], "double_value": r["value"] * 2}, output_schema=schema)
    return _through(t, stream).select("event_id", "double_value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_group_batch(t):
    out = _through(t, t.session.read_stream(_events_stream(t)).groupby("event_type").count())
    return out.groupby("event_type").sum("count").rename({"count": "n"})


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(t):
    return t.events.select("date_format(window(ts, '1 hour').start, 'yyyy-MM-dd HH:mm:ss') AS hour", "event_type").groupby("hour", "event_type").count().rename({"count": "n"})


def _windows(df: DataFrame, *also: str) -> DataFrame:
    return df.select("date_format(window_start, 'yyyy-MM-dd HH:mm:ss') AS window_start", "date_format(window_end, 'yyyy-MM-dd HH:mm:ss') AS window_end", *also)


#: A window is given when the latest time, less the watermark, has passed its end.
_CLOSED = "WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'"


@query(f"SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, value FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3) {_CLOSED}")
def stream_window(t):
    out = _through(t, t.session.read_stream(_events_stream(t)).windowed("ts", "1 hour", keys=["event_type"], aggs={"value": "sum"}, watermark="10 minutes"))
    return _windows(out, "event_type", "round(value, 4) AS value")


@query(f"SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, n FROM (SELECT s AS window_start, s + INTERVAL '2 hours' AS window_end, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY 1) {_CLOSED}")
def stream_sliding(t):
    out = _through(t, t.session.read_stream(_events_stream(t)).windowed("ts", "2 hours", "1 hour", watermark="10 minutes"))
    return _windows(out, "`count` AS n")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'")
def stream_sessions(t):
    out = _through(t, t.session.read_stream(_events_stream(t)).windowed("ts", "30 minutes", keys=["user_id"], watermark="10 minutes", session_gap=True))
    return _windows(out, "user_id", "`count` AS n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedupe(t):
    out = _through(t, t.session.read_stream(_events_stream(t)).deduplicated(["user_id", "event_type"], "ts", "3650 days"))
    return out.groupby("user_id", "event_type").count().rename({"count": "n"})


@query("SELECT event_type, max(value) AS top FROM events WHERE value > 1 GROUP BY 1")
def stream_sql_and_batches(t):
    """SQL over each batch, and a function of Arrow batches."""
    schema = pa.schema([("event_type", pa.string()), ("value", pa.float64())])
    stream = t.session.read_stream(_events_stream(t)).select("event_type", "value").map_batches(lambda b: b.filter(pc.greater(b["value"], 1.0)), output_schema=schema)
    return _through(t, stream.sql("SELECT event_type, max(value) AS value FROM this GROUP BY event_type")).groupby("event_type").agg({"value": "max"}).rename({"value": "top"})


@query("SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation")
def stream_custom_source_and_sink(t):
    """Rows of a polled source, batch by batch, to a sink that is a function."""
    from lakepipe.streaming import CallbackSink, QueueSource

    source = QueueSource(pa.schema([("k", pa.int64())]))
    source.put(*[{"k": r["n_nationkey"]} for r in t.nation.to_arrow().to_pylist()])
    found: list[pa.Table] = []
    t.session.read_stream(source, batch_size=10).filter("k >= 0").to(CallbackSink(found.append)).run(available_now=True)
    return t.session.from_arrow(pa.concat_tables(found)).groupby().agg({"*": "count", "k": "sum"}).rename({"count": "n", "k": "s"})


# ---- end to end


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_quantity > 5 AND l_returnflag != 'A' GROUP BY 1")
def pipeline_workload(t):
    schema = pa.schema([("l_suppkey", pa.int64()), ("revenue", pa.float64())])

    def revenue(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"l_suppkey": b["l_suppkey"], "revenue": pc.multiply(b["l_extendedprice"], pc.subtract(1.0, b["l_discount"]))})

    df = t.lineitem.filter("l_quantity > 5 AND l_returnflag != 'A'").select("l_suppkey", "l_extendedprice", "l_discount").repartition(8, partition_by="l_suppkey")
    return df.map_batches(revenue, 8192, schema).groupby("l_suppkey").sum("revenue").select("l_suppkey", "round(revenue, 2) AS revenue")


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def star_join(t):
    return t.session.sql(
        "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM l JOIN o ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey JOIN r ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
        l=t.lineitem, o=t.orders, c=t.customer, n=t.nation, r=t.region,
    )
