"""Relational pieces beside rules: predicates, set operations, outer union, comparison."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TypeMismatch(TypeError):
    """Operands of different type classes."""


_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_CLASSES = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "double", "double": "double", "string": "string", "boolean": "bool", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def compare(df: DataFrame, left: str, op: str, right: object, right_is_column: bool = False) -> Column:
    """``left op right`` where both sides are of one type class (a column, or a literal)."""
    kinds = dict(df.dtypes)
    own = _CLASSES.get(kinds[left])
    if right_is_column:
        if _CLASSES.get(kinds[str(right)]) != own:
            raise TypeMismatch(f"{left} and {right}")
        return _OPS[op](F.col(left), F.col(str(right)))
    fits = {"int": int, "long": int, "double": float, "string": str, "bool": bool}.get(own)
    if fits and (not isinstance(right, fits) or (fits is int and isinstance(right, bool))):
        raise TypeMismatch(f"{left} and {right!r}")
    return _OPS[op](F.col(left), F.lit(right))


def all_of(*tests: Column) -> Column:
    return reduce(operator.and_, tests)


def any_of(*tests: Column) -> Column:
    return reduce(operator.or_, tests)


def outer_union(frames: dict[str, DataFrame], tag: str = "MRULE") -> DataFrame:
    """All rows under all columns, missing ones null, with the frame's name in ``tag``."""
    parts = [df.withColumn(tag, F.lit(n)) for n, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def difference_count(a: DataFrame, b: DataFrame) -> int:
    """Number of rows in exactly one of two sets."""
    return a.subtract(b).unionByName(b.subtract(a)).count()


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts by table, in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def group(df: DataFrame, by: list[str], aggregates: dict[str, Column], having: Column | None = None) -> DataFrame:
    """GROUP BY with named aggregates and HAVING over their names."""
    out = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.where(having) if having is not None else out


def ordered(df: DataFrame, items: list[tuple[str, str, str]]) -> DataFrame:
    """ORDER BY (column, asc|desc, first|last)."""
    by = {("asc", "first"): Column.asc_nulls_first, ("asc", "last"): Column.asc_nulls_last, ("desc", "first"): Column.desc_nulls_first, ("desc", "last"): Column.desc_nulls_last}
    return df.orderBy(*[by[d.lower(), n.lower()](F.col(c)) for c, d, n in items])
