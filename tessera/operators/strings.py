"""String values: ranges, patches, bits and packed fields, as column expressions over UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_range(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    """Inclusive bounds from 0 after negatives count from the end; empty where first > last."""
    first = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    last = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return first, last


def getrange(value: Column, start: int, stop: int) -> Column:
    raw = F.coalesce(value, F.lit("")).cast("binary")
    first, last = clamp_range(F.octet_length(raw), start, stop)
    return F.when(first > last, F.lit("")).otherwise(F.substring(raw, first + 1, last - first + 1).cast("string"))


def setrange(value: Column, offset: int, patch: str) -> Column:
    """value overwritten from a byte offset, padded with zero bytes."""
    text = F.coalesce(value, F.lit(""))
    padded = F.when(F.length(text) < offset, F.rpad(text, offset, "\0")).otherwise(text)
    return F.overlay(padded, F.lit(patch), F.lit(offset + 1), F.lit(len(patch)))


def append(value: Column, more: Column) -> Column:
    return F.concat(F.coalesce(value, F.lit("")), more)


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def getbit(value: Column, offset: int) -> Column:
    """Bit of a byte string, most significant first; 0 beyond the end."""
    byte = F.conv(F.hex(F.substring(value.cast("binary"), offset // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, F.lit(7 - offset % 8)).bitwiseAND(1), F.lit(0))


def bitcount(value: Column, start: int = 0, stop: int = -1) -> Column:
    """Set bits in a byte range."""
    raw = value.cast("binary")
    first, last = clamp_range(F.octet_length(raw), start, stop)
    digits = F.hex(F.when(first > last, F.lit("").cast("binary")).otherwise(F.substring(raw, first + 1, last - first + 1)))
    by_digit = F.transform(
        F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: F.bit_count(F.conv(d, 16, 10).cast("int"))
    )
    return F.coalesce(F.aggregate(by_digit, F.lit(0), lambda a, b: a + b), F.lit(0))


def bitpos(value: Column, bit: int) -> Column:
    """Position of the first such bit; -1 where there is none."""
    digits = F.filter(F.split(F.hex(value.cast("binary")), ""), lambda d: d != "")
    bits = F.array_join(F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")
    return (F.locate(str(bit), bits) - 1).cast("long")


def field_wrap(value: Column, bits: int) -> Column:
    """Signed field of some bits after overflow wraps."""
    size = 1 << bits
    return F.pmod(value + size // 2, F.lit(size)) - size // 2


def field_saturate(value: Column, bits: int) -> Column:
    half = 1 << (bits - 1)
    return F.least(F.greatest(value, F.lit(-half)), F.lit(half - 1))


def field_get(value: Column, offset: int, bits: int) -> Column:
    """Unsigned field of an integer, counted from the low end."""
    return F.shiftright(value, offset).bitwiseAND((1 << bits) - 1)


def lcs():
    """UDF for the longest common subsequence of two strings: its text.

    Rows of the table are kept as vectors; the walk back takes the left string's step first on ties.
    """
    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        right = np.frombuffer(b.encode("utf-32-le"), dtype="<u4")
        rows = [np.zeros(len(b) + 1, dtype=np.int64)]
        for ch in a:
            up = rows[-1]
            grown = up.copy()
            grown[1:] = np.maximum(up[1:], np.where(right == ord(ch), up[:-1] + 1, 0))
            rows.append(np.maximum.accumulate(grown))
        i, j, out = len(a), len(b), []
        while i and j:
            if a[i - 1] == b[j - 1]:
                out.append(a[i - 1])
                i, j = i - 1, j - 1
            elif rows[i - 1][j] >= rows[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return "".join(reversed(out))

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run
