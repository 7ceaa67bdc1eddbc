"""Number parsing and arithmetic with the semantics that queries over text values rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def go_float(c: Column) -> Column:
    """Strict decimal parsing: no blanks, no type suffix; null where the text isn't a number."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def div_keep(left: Column, right: Column) -> Column:
    """left / right, and left where right is 0."""
    return F.when(right != 0, left / right).otherwise(left)


def trunc_div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero."""
    return ((a - a % b) / b).cast("long")


def bucket(ts: Column, size: int, align: int = 0) -> Column:
    """Start of a time bucket; timestamps before align fall into the bucket above."""
    offset = ts - align
    return (offset - offset % size + align).cast("long")


def percentile_at(values: Column, p: float) -> Column:
    """values' element number int(n * p), the last at most; values is an array."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    at = F.least((n * p).cast("int") + 1, n)
    return F.when(n > 0, F.try_element_at(ordered, at))
