"""Group-by, global aggregates, grouping sets and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from lakepipe.functions import aggregate_column


def columns_of(aggs: dict[str, str | list[str]]) -> list[Column]:
    """A dict of column to function name; with a list of names the outputs are called ``column_function``."""
    if not aggs:
        raise ValueError("nothing to aggregate")
    out = []
    for column, functions in aggs.items():
        if isinstance(functions, str):
            out.append(aggregate_column(column, functions).alias("count" if column == "*" else column))
        elif not isinstance(functions, (list, tuple)):
            raise ValueError(f"not an aggregate's name: {functions!r}")
        else:
            out += [aggregate_column(column, f).alias(f"{'rows' if column == '*' else column}_{f}") for f in functions]
    return out


def aggregate(df: DataFrame, keys: list[str], aggs: dict, n_partitions: int = 0, mode: str = "groupby") -> DataFrame:
    """Partial sums where the rows are, one shuffle of them, final sums. No key: one row.

    ``n_partitions``: over how many partitions the finished groups are dealt, by key.
    """
    columns = columns_of(aggs)
    if not keys:
        return df.agg(*columns)
    group = {"groupby": df.groupBy, "rollup": df.rollup, "cube": df.cube}[mode]
    found = group(*keys).agg(*columns)
    return found.repartition(n_partitions, *[found[i] for i in range(len(keys))]) if n_partitions else found
