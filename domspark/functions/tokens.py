"""Predicates of token-table rows, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from domspark.functions.text import fold, to_lower


def is_open() -> Column:
    return F.col("type") == "open"


def is_close() -> Column:
    return F.col("type") == "close"


def is_close_self() -> Column:
    return F.col("type") == "close_self"


def is_text() -> Column:
    return F.col("type") == "text"


def is_comment() -> Column:
    return F.col("type") == "comment"


def is_doctype() -> Column:
    return F.col("type") == "doctype"


def is_force_quirks() -> Column:
    return F.col("force_quirks")


def is_tag(name: str) -> Column:
    """Any tag token of that name."""
    return F.col("type").isin("open", "close", "close_self") & (to_lower(F.col("name")) == fold(name))
