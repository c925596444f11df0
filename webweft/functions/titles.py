"""Expressions on page titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(title: Column) -> Column:
    """A title as typed by a reader: outer white space off, inner spaces as underscores."""
    return F.replace(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""), F.lit(" "), F.lit("_"))


def capitals(title: Column) -> Column:
    """The full Unicode upper case of a title."""
    return F.upper(title)
