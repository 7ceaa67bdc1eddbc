"""List operators on array columns, with positions from 0 and negatives from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.strings import clamp_range


def lpush(a: Column, *values: Column) -> Column:
    """Values pushed one by one to the head: the last ends up first."""
    return F.concat(F.array(*reversed(values)), a)


def rpush(a: Column, *values: Column) -> Column:
    return F.concat(a, F.array(*values))


def lindex(a: Column, i: int) -> Column:
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def lrange(a: Column, start: int, stop: int) -> Column:
    first, last = clamp_range(F.size(a), start, stop)
    return F.when(first > last, F.slice(a, 1, 0)).otherwise(F.slice(a, first + 1, last - first + 1))


def lset(a: Column, i: int, value: Column) -> Column:
    at = F.lit(i) if i >= 0 else F.size(a) + i
    return F.transform(a, lambda x, k: F.when(k == at, value).otherwise(x))


def lrem(a: Column, count: int, value: Column) -> Column:
    """Without the first count matches, the last -count ones, or all for 0."""
    if count == 0:
        return F.filter(a, lambda x: ~x.eqNullSafe(value))
    seen = lambda part: F.size(F.filter(part, lambda x: x.eqNullSafe(value)))
    if count > 0:
        return F.filter(a, lambda x, k: ~(x.eqNullSafe(value) & (seen(F.slice(a, 1, k + 1)) <= count)))
    return F.filter(a, lambda x, k: ~(x.eqNullSafe(value) & (seen(F.slice(a, k + 1, F.size(a) - k)) <= -count)))


def linsert(a: Column, pivot: Column, value: Column, after: bool = False) -> Column:
    """value before or after the first pivot; null where the pivot is absent."""
    at = F.array_position(a, pivot).cast("int")
    return F.when(at > 0, F.concat(F.slice(a, 1, at - 1 + int(after)), F.array(value), F.slice(a, at + int(after), F.size(a))))


def lpos(a: Column, value: Column, rank: int = 1, count: int | None = None) -> Column:
    """Positions of value: from the rank-th match on, or backwards for a negative rank; one unless count says (0: all)."""
    found = F.filter(F.transform(a, lambda x, k: F.when(x.eqNullSafe(value), k)), lambda k: k.isNotNull())
    ordered = found if rank > 0 else F.reverse(found)
    rest = F.slice(ordered, abs(rank), F.greatest(F.size(ordered), F.lit(1)))
    return rest if count == 0 else F.slice(rest, 1, count or 1)


def rotate(a: Column, source_left: bool = False, target_left: bool = True) -> Column:
    """Pop from one end and push to the other end of the same list."""
    if source_left == target_left:
        return a
    n = F.size(a)
    moved = F.concat(F.slice(a, n, 1), F.slice(a, 1, n - 1)) if target_left else F.concat(F.slice(a, 2, n), F.slice(a, 1, 1))
    return F.when(n > 1, moved).otherwise(a)


def pushx(v: Column, x: Column, left: bool = False) -> Column:
    """One more element, if the list exists and isn't empty."""
    return F.when(F.size(v) > 0, F.concat(F.array(x), v) if left else F.concat(v, F.array(x))).otherwise(v)
