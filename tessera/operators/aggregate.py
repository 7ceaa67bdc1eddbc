"""The aggregation pipeline: a linear list of stages over hits, with its own expression language.

aggregate(rows, ["GROUPBY", "1", "@x", "REDUCE", "SUM", "1", "@y", "AS", "t", …]) compiles to DataFrame operations. Rows
carry __pos, their order, which first values, lists and stable sorts refer to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.num import go_float

_PART = re.compile(r"\s*(@\w+|\d+\.?\d*|\.\d+|'[^']*'|\"[^\"]*\"|==|!=|<=|>=|&&|\|\||[-+*/()<>])")
_LEVELS = (("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/"))


class _Expression:
    def __init__(self, text: str, dtypes: dict[str, str]):
        self.parts, self.dtypes = [], dtypes
        at = 0
        while at < len(text.rstrip()):
            m = _PART.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:]!r}")
            self.parts.append(m.group(1))
            at = m.end()

    def number(self, name: str) -> Column:
        c = F.col(name)
        return F.coalesce(go_float(c) if self.dtypes.get(name, "string") == "string" else c.cast("double"), F.lit(0.0))

    def take(self) -> str:
        return self.parts.pop(0) if self.parts else ""

    def read(self, level: int = 0) -> Column:
        if level == len(_LEVELS):
            return self.atom()
        left = self.read(level + 1)
        while self.parts and self.parts[0] in _LEVELS[level]:
            op, right = self.take(), self.read(level + 1)
            left = _combine(op, left, right)
        return left

    def atom(self) -> Column:
        part = self.take()
        if part == "(":
            inner = self.read()
            self.take()
            return inner
        if part == "-":  # a sign stands for 0 less what follows
            return F.lit(0.0) - self.atom()
        if part.startswith("@"):
            return self.number(part[1:])
        return F.lit(float(part)) if part[:1] not in "'\"" else F.lit(0.0)


def _combine(op: str, a: Column, b: Column) -> Column:
    truth = lambda c: c.cast("boolean")
    return {
        "+": lambda: a + b,
        "-": lambda: a - b,
        "*": lambda: a * b,
        "/": lambda: F.when(b != 0, F.try_divide(a, b)).otherwise(a),
        "==": lambda: a == b,
        "!=": lambda: a != b,
        "<": lambda: a < b,
        "<=": lambda: a <= b,
        ">": lambda: a > b,
        ">=": lambda: a >= b,
        "&&": lambda: truth(a) & truth(b),
        "||": lambda: truth(a) | truth(b),
    }[op]()


def expression(text: str, rows: DataFrame) -> Column:
    """A numeric or boolean expression over @fields; fields that aren't numbers count as 0, x / 0 is x."""
    return _Expression(text, dict(rows.dtypes)).read()


def reducer(fn: str, name: str | None, dtypes: dict[str, str]) -> Column:
    text = F.coalesce(F.col(name).cast("string"), F.lit("")) if name else None
    if name:
        number = go_float(F.col(name)) if dtypes[name] == "string" else F.col(name).cast("double")
        zeroed = F.coalesce(number, F.lit(0.0))
    return {
        "COUNT": lambda: F.count(F.lit(1)),
        "SUM": lambda: F.sum(zeroed),
        "MIN": lambda: F.min(zeroed),
        "MAX": lambda: F.max(zeroed),
        "AVG": lambda: F.coalesce(F.avg(number), F.lit(0.0)),
        "COUNT_DISTINCT": lambda: F.count_distinct(text),
        "FIRST_VALUE": lambda: F.min_by(text, "__pos"),
        "TOLIST": lambda: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__pos", text.alias("v")))), lambda x: x["v"])), ","),
    }[fn.upper()]()


def aggregate(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Run the stages; rows need __pos where order matters."""
    args = list(stages)
    pop = lambda: args.pop(0)
    out = rows
    while args:
        stage = pop().upper()
        if stage == "GROUPBY":
            keys = [pop()[1:] for _ in range(int(pop()))]
            reducers = []
            while args and args[0].upper() == "REDUCE":
                pop()
                fn, names = pop(), [pop()[1:] for _ in range(int(pop()))]
                alias = fn.lower()
                if args and args[0].upper() == "AS":
                    pop()
                    alias = pop()
                reducers.append(reducer(fn, names[0] if names else None, dict(out.dtypes)).alias(alias))
            if "__pos" in out.columns:
                reducers.append(F.min("__pos").alias("__pos"))
            kept = [F.coalesce(F.col(k), F.lit("")).alias(k) if dict(out.dtypes)[k] == "string" else F.col(k) for k in keys]
            out = out.groupBy(*kept).agg(*(reducers or [F.count(F.lit(1)).alias("count")]))
        elif stage == "APPLY":
            text = pop()
            pop()
            name = pop()
            out = out.withColumn(name, expression(text, out))
        elif stage == "FILTER":
            out = out.where(expression(pop(), out).cast("boolean"))
        elif stage == "SORTBY":
            parts = [pop() for _ in range(int(pop()))]
            order = []
            for i, part in enumerate(parts):
                if part.startswith("@"):
                    down = i + 1 < len(parts) and parts[i + 1].upper() == "DESC"
                    c = F.col(part[1:])
                    for key in ([go_float(c), c] if dict(out.dtypes)[part[1:]] == "string" else [c]):
                        order.append(key.desc() if down else key.asc())
            out = out.orderBy(*order, *(["__pos"] if "__pos" in out.columns else []))
        elif stage == "LIMIT":
            offset, count = int(pop()), int(pop())
            out = out.offset(offset).limit(count)
        else:
            raise ValueError(f"no stage is named {stage}")
    return out
