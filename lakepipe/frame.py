"""The frame: an immutable handle on a Spark plan."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from lakepipe.functions import check_dialect
from lakepipe.operators import joins, ordering, partitioning, udf
from lakepipe.operators.aggregate import aggregate
from lakepipe.plans import explain_text
from lakepipe.sources import sinks

_views = threading.Lock()


def sql_over(spark, query: str, frames: dict[str, SparkFrame]) -> SparkFrame:
    """``query`` with each name standing for its frame. Analysis is immediate, so the views go at once."""
    check_dialect(query)
    with _views:
        held = {}
        for name, df in frames.items():
            if spark.catalog.tableExists(name) and any(t.name == name and t.isTemporary for t in spark.catalog.listTables()):
                held[name] = spark.table(name)
            df.createOrReplaceTempView(name)
        try:
            return spark.sql(query)
        finally:
            for name in frames:
                spark.catalog.dropTempView(name)
                if name in held:
                    held[name].createOrReplaceTempView(name)


class GroupedDataFrame:
    """Keys waiting for an aggregation."""

    def __init__(self, frame: DataFrame, keys: list[str], n_partitions: int = 0, mode: str = "groupby") -> None:
        self._frame, self._keys, self._n, self._mode = frame, keys, n_partitions, mode

    def agg(self, aggs: dict[str, str | list[str]]) -> DataFrame:
        """``{"price": "sum"}``; the output keeps the column's name. A list of functions gives ``price_sum`` and so on."""
        return self._frame._with(lambda: aggregate(self._frame.spark_frame, self._keys, aggs, self._n, self._mode))

    def count(self) -> DataFrame:
        return self.agg({"*": "count"})

    def sum(self, *columns: str) -> DataFrame:
        return self.agg(dict.fromkeys(columns, "sum"))

    def mean(self, *columns: str) -> DataFrame:
        return self.agg(dict.fromkeys(columns, "mean"))

    def min(self, *columns: str) -> DataFrame:
        return self.agg(dict.fromkeys(columns, "min"))

    def max(self, *columns: str) -> DataFrame:
        return self.agg(dict.fromkeys(columns, "max"))

    def pivot(self, column: str, values: list, aggs: dict[str, str]) -> DataFrame:
        """One column a value (and function). The values are given, so no extra job looks for them."""
        from lakepipe.operators.aggregate import columns_of

        return self._frame._with(lambda: self._frame.spark_frame.groupBy(*self._keys).pivot(column, values).agg(*columns_of(aggs)))


class DataFrame:
    """Lazy and immutable: every method gives a new frame, and only actions run anything."""

    def __init__(self, spark_frame: SparkFrame | Callable[[], SparkFrame], session, pending: tuple[Callable[[], None], ...] = ()) -> None:
        """``spark_frame``: a function, where the plan needs rows to be looked at; it is called once, when the plan is needed."""
        self._made = spark_frame if isinstance(spark_frame, SparkFrame) else None
        self._make = None if self._made is not None else spark_frame
        self._session, self._pending, self._done = session, pending, False
        self._lock = threading.RLock()

    @property
    def _df(self) -> SparkFrame:
        if self._made is None:
            with self._lock:
                if self._made is None:
                    self._made, self._make = self._make(), None
        return self._made

    def _with(self, make: Callable[[], SparkFrame], *others: DataFrame, late: bool = False) -> DataFrame:
        """A frame over this one and ``others``, whose writes come first. Plans are made (and checked) at once, but for those that
        are ``late`` or over such."""
        frames = (self, *others)
        pending = tuple(f._flush for f in frames if f._pending)
        late = late or any(f._made is None for f in frames)
        return DataFrame(make if late else make(), self._session, pending)

    @property
    def spark_frame(self) -> SparkFrame:
        return self._df

    @property
    def schema(self):
        return self._df.schema

    @property
    def columns(self) -> list[str]:
        return self._df.columns

    def __repr__(self) -> str:
        return f"DataFrame[{', '.join(f'{n}: {t}' for n, t in self._df.dtypes)}]"

    # ---- rows and columns

    def filter(self, predicate: str | Callable[[dict], bool]) -> DataFrame:
        """SQL text (which reaches the scan) or a function of a row."""
        if callable(predicate):
            return self._with(lambda: udf.filter_rows(self._df, predicate))
        return self._with(lambda: self._df.where(F.expr(check_dialect(predicate))))

    def select(self, *columns: str) -> DataFrame:
        """Names or SQL expressions."""
        return self._with(lambda: self._df.selectExpr(*[check_dialect(c) for c in columns]))

    def with_column(self, name: str, expression: str) -> DataFrame:
        return self._with(lambda: self._df.withColumn(name, F.expr(expression)))

    def drop(self, *columns: str) -> DataFrame:
        return self._with(lambda: self._df.drop(*columns))

    def rename(self, names: dict[str, str]) -> DataFrame:
        return self._with(lambda: self._df.withColumnsRenamed(names))

    def map(self, fn: Callable[[dict], dict], output_schema=None) -> DataFrame:
        return self._with(lambda: udf.map_rows(self._df, fn, output_schema), late=output_schema is None)

    def flatmap(self, fn: Callable[[dict], list[dict]], output_schema=None) -> DataFrame:
        return self._with(lambda: udf.flatmap_rows(self._df, fn, output_schema), late=output_schema is None)

    def map_batches(self, fn: Callable[[pa.RecordBatch], pa.RecordBatch], batch_size: int = 1024, output_schema=None) -> DataFrame:
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        return self._with(lambda: udf.map_batches(self._df, fn, batch_size, output_schema), late=output_schema is None)

    def limit(self, n: int) -> DataFrame:
        """``n`` rows of the whole frame."""
        return self._with(lambda: self._df.limit(n))

    def local_limit(self, n: int) -> DataFrame:
        """Up to ``n`` rows of each partition."""
        return self._with(lambda: partitioning.local_limit(self._df, n))

    def offset(self, n: int) -> DataFrame:
        """All but the first ``n`` rows; a sorted frame keeps its order."""
        return self._with(lambda: self._df.offset(n))

    def with_window(self, name: str, expression: str, partition_by=(), order_by=(), rows: tuple[int | None, int | None] | None = None, range_: tuple[int | None, int | None] | None = None) -> DataFrame:
        """A column of a window function or aggregate: ``with_window("r", "rank()", "k", "-v")``.

        ``rows`` and ``range_``: from and to, relative to the row, None for unbounded.
        """
        return self._with(lambda: ordering.with_window(self._df, name, check_dialect(expression), partition_by, order_by, rows, range_))

    def distinct(self) -> DataFrame:
        return self._with(lambda: self._df.distinct())

    def drop_duplicates(self, columns: list[str] | None = None) -> DataFrame:
        return self._with(lambda: self._df.dropDuplicates(columns) if columns else self._df.dropDuplicates())

    def sample(self, fraction: float, seed: int = 0) -> DataFrame:
        return self._with(lambda: self._df.sample(fraction=fraction, seed=seed))

    def fill_null(self, value, columns: list[str] | None = None) -> DataFrame:
        return self._with(lambda: self._df.fillna(value, columns))

    def explode(self, column: str, name: str | None = None) -> DataFrame:
        """A row for each element; rows with a null or empty array go."""
        return self._with(lambda: self._df.withColumn(name or column, F.explode(self._df[column])))

    def unpivot(self, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
        return self._with(lambda: self._df.unpivot(ids, values, variable, value))

    # ---- order

    def sort(self, *by: str) -> DataFrame:
        """Names, ``-name`` for descending."""
        return self._with(lambda: ordering.sort(self._df, by))

    def top_k(self, k: int, by, per=None) -> DataFrame:
        return self._with(lambda: ordering.top_k(self._df, k, by, per))

    # ---- partitions

    def repartition(self, n_partitions: int = 0, partition_by=None, partition_spec=None) -> DataFrame:
        """Round robin, by key, or by a spec (also of ranges, or of a function)."""
        if partition_spec is not None and partition_by is not None:
            raise ValueError("give partition_by or partition_spec, not both")
        if partition_spec is None:
            if partition_by is not None:
                keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
                partition_spec = partitioning.HashPartitionSpec(keys, n_partitions)
            else:
                partition_spec = partitioning.EvenPartitionSpec(n_partitions)
        return self._with(lambda: partitioning.repartition(self._df, partition_spec))

    @property
    def n_partitions(self) -> int:
        return self._df.rdd.getNumPartitions()

    # ---- groups, joins, sets, SQL

    def groupby(self, *keys: str, n_partitions: int = 0) -> GroupedDataFrame:
        return GroupedDataFrame(self, list(keys), n_partitions)

    def rollup(self, *keys: str) -> GroupedDataFrame:
        return GroupedDataFrame(self, list(keys), mode="rollup")

    def cube(self, *keys: str) -> GroupedDataFrame:
        return GroupedDataFrame(self, list(keys), mode="cube")

    def join(self, other: DataFrame, on=None, how: str = "inner", partition_spec=None, broadcast: bool = False, left_suffix: str = "_left", right_suffix: str = "_right", *, left_on=None, right_on=None, strategy: str | None = None) -> DataFrame:
        """See operators.joins.join. The left's names never change, so ``left_suffix`` has no use; a hash
        ``partition_spec`` deals both sides to its number of partitions."""
        def made() -> SparkFrame:
            left, right = self._df, other._df
            if partition_spec is not None and not broadcast:
                n = partition_spec.n_partitions
                if n and on is not None:
                    keys = [on] if isinstance(on, str) else list(on)
                    left, right = left.repartition(n, *keys), right.repartition(n, *keys)
            return joins.join(left, right, on, how, left_on=left_on, right_on=right_on, broadcast=broadcast, right_suffix=right_suffix, strategy=strategy)

        return self._with(made, other)

    def cross_join(self, other: DataFrame) -> DataFrame:
        """Every row with every row; a name that is on both sides is an error."""

        def made() -> SparkFrame:
            if both := [c for c in self.columns if c in other.columns]:
                raise ValueError(f"both sides have {', '.join(both)}")
            return self._df.crossJoin(other._df)

        return self._with(made, other)

    def join_asof(self, other: DataFrame, on: str, by=None, right_suffix: str = "_right", slices: int | None = None) -> DataFrame:
        return self._with(lambda: joins.join_asof(self._df, other._df, on, by, right_suffix=right_suffix, slices=slices), other)

    def join_range(self, other: DataFrame, point: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
        return self._with(lambda: joins.join_range(self._df, other._df, point, start, end, width, how), other)

    def union(self, other: DataFrame, distinct: bool = False) -> DataFrame:
        """By column name."""

        def made() -> SparkFrame:
            out = self._df.unionByName(other._df)
            return out.distinct() if distinct else out

        return self._with(made, other)

    def intersect(self, other: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
        return self._with(lambda: self._df.intersectAll(other._df) if all else self._df.intersect(other._df), other)

    def difference(self, other: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
        return self._with(lambda: self._df.exceptAll(other._df) if all else self._df.subtract(other._df), other)

    def sql(self, query: str) -> DataFrame:
        """SQL over this frame, called ``this``."""
        return self._with(lambda: sql_over(self._df.sparkSession, query, {"this": self._df}))

    # ---- writers: nothing is written before an action

    def _to_write(self, fn: Callable[[], None]) -> DataFrame:
        return DataFrame(self._made if self._made is not None else lambda: self._df, self._session, (*((self._flush,) if self._pending else ()), fn))

    def write_parquet(self, path: str, compression: str = "snappy", partition_cols=None, n_partitions: int | None = None) -> DataFrame:
        return self._to_write(lambda: sinks.write_parquet(self._df, path, compression, partition_cols, n_partitions))

    def write_orc(self, path: str, compression: str = "snappy", partition_cols=None) -> DataFrame:
        return self._to_write(lambda: sinks.write_files(self._df, "orc", path, partition_cols, compression=compression))

    def write_json(self, path: str, partition_cols=None) -> DataFrame:
        """A JSON object a line."""
        return self._to_write(lambda: sinks.write_files(self._df, "json", path, partition_cols, ignoreNullFields="false"))

    def write_csv(self, path: str, delimiter: str = ",", include_header: bool = True) -> DataFrame:
        return self._to_write(lambda: sinks.write_csv(self._df, path, delimiter, include_header))

    # ---- actions

    def _flush(self) -> None:
        with self._lock:
            if not self._done:
                for fn in self._pending:
                    fn()
                self._done = True

    def _run(self, name: str, action: Callable):
        with self._session.observer.observe_task(name, self._session.spark) as found:
            self._flush()
            out = action()
            if (rows := len(out) if hasattr(out, "__len__") else out if isinstance(out, int) else None) is not None:
                found["rows_out"] = rows
            return out

    def compute(self) -> DataFrame:
        """Runs the plan once and keeps the rows (in memory, then on disk) for frames that build on the result."""
        kept = self._df.persist()
        self._run("compute", kept.count)
        return DataFrame(kept, self._session)

    def unpersist(self) -> DataFrame:
        self._df.unpersist()
        return self

    def count(self) -> int:
        return self._run("count", self._df.count)

    def to_arrow(self) -> pa.Table:
        return self._run("to_arrow", self._df.toArrow)

    def to_pandas(self):
        return self._run("to_pandas", self._df.toPandas)

    def show(self, n: int = 20) -> None:
        print(self._run("show", self._df.limit(n).toPandas).to_string())

    def explain(self, mode: str = "logical") -> str:
        """Prints the plan and returns it."""
        text = explain_text(self._df, mode)
        print(text)
        return text
