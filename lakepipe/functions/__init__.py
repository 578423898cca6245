"""SQL names: aggregate lookup, identifier quoting and dialect checks."""

from lakepipe.functions.aggregates import aggregate_column
from lakepipe.functions.dialect import check_dialect, quote

__all__ = ["aggregate_column", "check_dialect", "quote"]
