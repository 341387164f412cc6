"""Built-in predicates as Catalyst columns.

In ``ARITH`` and ``STRING`` atoms the first argument is the output; ``COMPARE`` atoms only
have inputs.  Results are null if an input is null, also for LEAST and GREATEST.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnknownFunction(ValueError):
    """A name in a built-in schema that is not a function."""


def _all_or_null(f: Callable[..., Column]) -> Callable[..., Column]:
    """``f`` of all arguments, null if one is."""

    def guarded(*args: Column) -> Column:
        missing = reduce(operator.or_, [a.isNull() for a in args])
        return F.when(~missing, f(*args))

    return guarded


def _sum(*args: Column) -> Column:
    return reduce(operator.add, [a.cast("double") for a in args])


def _div(a: Column, b: Column) -> Column:
    """Truncating integer division; a zero divisor gives null."""
    return F.when(b != 0, F.call_function("div", a.cast("bigint"), b.cast("bigint")))


def _like(a: Column, b: Column) -> Column:
    return F.call_function("like", a, b)


_INT = {"INTADD": operator.add, "INTSUB": operator.sub, "INTMUL": operator.mul}
_DBL = {"DBLADD": operator.add, "DBLSUB": operator.sub, "DBLMUL": operator.mul}
_COMPARE = {"LESS": operator.lt, "LESSEQUAL": operator.le, "GREATER": operator.gt, "GREATEREQUAL": operator.ge, "EQUAL": operator.eq, "NOTEQUAL": operator.ne}
_ARITIES = range(2, 8)


def _table() -> dict[str, tuple[int, Callable[..., Column]]]:
    """Name to (number of inputs, function), built by rule from the families."""
    t: dict[str, tuple[int, Callable[..., Column]]] = {}
    for name, op in _INT.items():
        t[f"ARITH.{name}"] = (2, lambda a, b, op=op: op(a.cast("bigint"), b.cast("bigint")))
    for name, op in _DBL.items():
        t[f"ARITH.{name}"] = (2, lambda a, b, op=op: op(a.cast("double"), b.cast("double")))
    t["ARITH.INTDIV"] = (2, _div)
    t["ARITH.DBLDIV"] = (2, lambda a, b: F.when(b != 0, a.cast("double") / b.cast("double")))
    for n in _ARITIES:
        for kind, to in (("INT", "bigint"), ("DBL", "double")):
            t[f"ARITH.{kind}LEAST{n}"] = (n, lambda *a, to=to: _all_or_null(F.least)(*[x.cast(to) for x in a]))
            t[f"ARITH.{kind}GREATEST{n}"] = (n, lambda *a, to=to: _all_or_null(F.greatest)(*[x.cast(to) for x in a]))
        t[f"ARITH.DBLSUM{n}"] = (n, _sum)
    t["ARITH.BITAND"] = (2, operator.and_)
    t["ARITH.BITOR"] = (2, operator.or_)
    t["STRING.STRCAT"] = (2, lambda a, b: F.concat(a.cast("string"), b.cast("string")))
    t["STRING.SUBSTR"] = (3, lambda s, a, n: F.substring(s, a.cast("int"), n.cast("int")))
    t["STRING.STRLEN"] = (1, lambda s: F.length(s).cast("bigint"))
    for kind in ("INT", "DBL"):
        for name, op in _COMPARE.items():
            t[f"COMPARE.{kind}{name}"] = (2, op)
    t["COMPARE.STRLIKE"] = (2, _like)
    return t


FUNCTIONS = _table()


def lookup(name: str, inputs: int) -> Callable[..., Column]:
    """The function of ``name``; a wrong name or number of inputs is an error."""
    found = FUNCTIONS.get(name.upper())
    if found is None:
        raise UnknownFunction(name)
    if found[0] != inputs:
        raise UnknownFunction(f"{name} takes {found[0]} inputs, not {inputs}")
    return found[1]


COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "LIKE": _like,
}
