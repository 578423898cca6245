"""Aggregates by name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakepipe.functions.dialect import quote

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

#: Names that other engines use, and Spark's.
ALIASES = {
    "list": "collect_list",
    "array_agg": "collect_list",
    "mean": "avg",
    "stddev_samp": "stddev",
    "string_agg": "listagg",
    "arbitrary": "any_value",
}


def aggregate_column(column: str, function: str) -> Column:
    """``function(column)``; ``*`` is for ``count`` only, and ``count_distinct`` counts different values.

    The name must be a plain identifier, so no SQL can be smuggled in through it.
    """
    if not isinstance(function, str) or not _NAME.match(function):
        raise ValueError(f"not an aggregate's name: {function!r}")
    name = ALIASES.get(function.lower(), function.lower())
    if column == "*":
        if name != "count":
            raise ValueError(f"only count takes '*', not {function}")
        return F.count(F.lit(1))
    if name in ("count_distinct", "nunique"):
        return F.count_distinct(F.expr(quote(column)))
    return F.expr(f"{name}({quote(column)})")
