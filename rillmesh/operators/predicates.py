"""Predicates as values: evaluated as Catalyst columns, written as SQL, kept as XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational


@dataclass(frozen=True)
class Compare:
    """A column against a literal, or against another column."""

    left: str
    op: str
    right: object
    column: bool = False

    def on(self, df: DataFrame) -> Column:
        return relational.compare(df, self.left, self.op, self.right, self.column)

    def sql(self, prefix: str = "") -> str:
        if self.column:
            right = f"{prefix}{self.right}"
        else:
            right = "'" + self.right.replace("'", "''") + "'" if isinstance(self.right, str) else str(self.right)
        return f"{prefix}{self.left} {'<>' if self.op == '!=' else self.op} {right}"


@dataclass(frozen=True)
class Test:
    """LIKE, IN, BETWEEN and IS NULL on a column."""

    left: str
    kind: str
    values: tuple = ()

    def on(self, df: DataFrame) -> Column:
        c = df[self.left]
        return {"like": lambda: c.like(self.values[0]), "in": lambda: c.isin(*self.values), "between": lambda: c.between(*self.values), "null": c.isNull}[self.kind]()

    def sql(self, prefix: str = "") -> str:
        v = ["'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in self.values]
        return f"{prefix}{self.left} " + {"like": lambda: f"LIKE {v[0]}", "in": lambda: f"IN ({', '.join(v)})", "between": lambda: f"BETWEEN {v[0]} AND {v[1]}", "null": lambda: "IS NULL"}[self.kind]()


@dataclass(frozen=True)
class All:
    parts: tuple

    def on(self, df: DataFrame) -> Column:
        return relational.all_of(*[p.on(df) for p in self.parts])

    def sql(self, prefix: str = "") -> str:
        return "(" + " AND ".join(p.sql(prefix) for p in self.parts) + ")"


@dataclass(frozen=True)
class Any:
    parts: tuple

    def on(self, df: DataFrame) -> Column:
        return relational.any_of(*[p.on(df) for p in self.parts])

    def sql(self, prefix: str = "") -> str:
        return "(" + " OR ".join(p.sql(prefix) for p in self.parts) + ")"


@dataclass(frozen=True)
class Negated:
    """Three-valued: unknown stays unknown."""

    part: object

    def on(self, df: DataFrame) -> Column:
        return ~self.part.on(df)

    def sql(self, prefix: str = "") -> str:
        return f"NOT ({self.part.sql(prefix)})"


Predicate = Compare | Test | All | Any | Negated
_KINDS = {"int": int, "float": float, "str": str, "bool": lambda s: s == "True"}


def _value(e: ET.Element) -> object:
    return _KINDS[e.get("type")](e.text or "")


def to_xml(p: Predicate) -> str:
    """The predicate as text that :func:`from_xml` reads back."""

    def build(p: Predicate) -> ET.Element:
        if isinstance(p, Compare):
            e = ET.Element("compare", left=p.left, op=p.op, column=str(p.column))
            v = ET.SubElement(e, "value", type=type(p.right).__name__)
            v.text = str(p.right)
        elif isinstance(p, Test):
            e = ET.Element("test", left=p.left, kind=p.kind)
            for x in p.values:
                ET.SubElement(e, "value", type=type(x).__name__).text = str(x)
        elif isinstance(p, Negated):
            e = ET.Element("not")
            e.append(build(p.part))
        else:
            e = ET.Element("and" if isinstance(p, All) else "or")
            e.extend(build(x) for x in p.parts)
        return e

    return ET.tostring(build(p), encoding="unicode")


def from_xml(text: str) -> Predicate:
    def read(e: ET.Element) -> Predicate:
        if e.tag == "compare":
            return Compare(e.get("left"), e.get("op"), _value(e.find("value")), e.get("column") == "True")
        if e.tag == "test":
            return Test(e.get("left"), e.get("kind"), tuple(_value(v) for v in e.findall("value")))
        parts = tuple(read(x) for x in e)
        return Negated(parts[0]) if e.tag == "not" else All(parts) if e.tag == "and" else Any(parts)

    return read(ET.fromstring(text))


def selected(df: DataFrame, p: Predicate) -> DataFrame:
    return df.where(p.on(df))


def sql_filter(df: DataFrame, p: Predicate) -> DataFrame:
    """The same rows through the predicate's SQL."""
    return df.where(F.expr(p.sql()))
