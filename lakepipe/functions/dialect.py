"""Identifier quoting and the few SQL texts that Spark would accept with another meaning."""

from __future__ import annotations

import re

_ASOF = re.compile(r"\basof\s+(?:left\s+|inner\s+)?join\b", re.IGNORECASE)
_STRINGS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.DOTALL)


def quote(name: str) -> str:
    """Backtick-quoted identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def check_dialect(sql: str) -> str:
    """Rejects ``ASOF JOIN``, which Spark would read as a table alias and run as a plain join."""
    if _ASOF.search(_STRINGS.sub(" ", sql)):
        raise ValueError("ASOF JOIN is not Spark SQL (it would run as an ordinary join); use DataFrame.join_asof")
    return sql
