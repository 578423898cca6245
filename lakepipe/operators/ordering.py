"""Sorting, top-k and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_columns(df: DataFrame, by) -> list[Column]:
    """``"x"`` ascending, ``"-x"`` descending; nulls last either way."""
    names = [by] if isinstance(by, str) else list(by)
    return [df[n[1:]].desc_nulls_last() if n.startswith("-") else df[n].asc_nulls_last() for n in names]


def sort(df: DataFrame, by) -> DataFrame:
    return df.orderBy(*order_columns(df, by))


def top_k(df: DataFrame, k: int, by, per=None) -> DataFrame:
    """The first ``k`` rows in that order, of all or of each ``per``.

    Each task keeps ``k`` rows (of each group) before the shuffle, so a large group costs no more than ``k`` rows a task.
    """
    if per is None:
        return sort(df, by).limit(k)
    keys = [per] if isinstance(per, str) else list(per)
    w = Window.partitionBy(*[df[c] for c in keys]).orderBy(*order_columns(df, by))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def with_window(df: DataFrame, name: str, expression: str, partition_by=(), order_by=(), rows=None, range_=None) -> DataFrame:
    """``df`` with ``expression`` over a window. One shuffle by ``partition_by``; without it all rows go through one task."""
    if rows is not None and range_ is not None:
        raise ValueError("give rows or range_, not both")
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    w = Window.partitionBy(*[df[k] for k in keys])
    if order_by:
        w = w.orderBy(*order_columns(df, order_by))
    edge = lambda x, unbounded: unbounded if x is None else x
    if rows is not None:
        w = w.rowsBetween(edge(rows[0], Window.unboundedPreceding), edge(rows[1], Window.unboundedFollowing))
    if range_ is not None:
        w = w.rangeBetween(edge(range_[0], Window.unboundedPreceding), edge(range_[1], Window.unboundedFollowing))
    return df.withColumn(name, F.expr(expression).over(w))
