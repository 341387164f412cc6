"""Provenance of query answers: polynomials, and values in a semiring.

A query is unfolded into rules over stored relations.  Each unfolded rule is one way to derive an
answer; its derivation tree turns into one Catalyst expression over the leaves' values,
multiplied inside a derivation, and alternatives of one answer are added by a grouped
aggregate (partial sums before the shuffle).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import Head, body, project, resolve, value_columns
from ..plans.rules import Atom, Rule
from ..plans.unfold import Tree, distinct_rules, unfold

COLUMN = "PROV__"


class InvalidAssignment(ValueError):
    """A leaf without a value."""


@dataclass(frozen=True)
class Semiring:
    """times within a derivation, plus across derivations, and the default leaf."""

    name: str
    times: Callable[[Column, Column], Column]
    plus: Callable[[Column], Column]
    default: int | None


#: Defaults are each semiring's zero (fixed values); sums run in 64 bits.
SEMIRINGS = {
    "TRUST": Semiring("TRUST", lambda a, b: a * b, F.max, 0),
    "MULTIPLICITY": Semiring("MULTIPLICITY", lambda a, b: a * b, F.sum, 0),
    "WEIGHT": Semiring("WEIGHT", lambda a, b: a + b, F.min, 2147483647),
    "MAX": Semiring("MAX", lambda a, b: a + b, F.max, -2147483648),
    "MIN": Semiring("MIN", lambda a, b: a + b, F.min, 2147483647),
}


def semiring(name: str) -> Semiring:
    """By case-insensitive name; any other is counting with no default leaf."""
    return SEMIRINGS.get(name.upper(), Semiring(name, lambda a, b: a * b, F.sum, None))


@dataclass(frozen=True)
class Assignment:
    """Leaf values: the first case whose pattern matches the whole relation name, else the
    default.  ``$$`` stands for the leaf, so ``$$.price * 2`` reads its column."""

    cases: tuple[tuple[str, str], ...] = ()
    default: str | None = None

    def expression(self, relation: str) -> str | None:
        short = relation.split(".")[-1]
        for pattern, text in self.cases:
            if re.fullmatch(pattern, relation) or re.fullmatch(pattern, short):
                return text
        return self.default


def parse_assignment(text: str) -> tuple[Semiring, Assignment]:
    """``EVALUATE <semiring> ASSIGNING EACH CASE <regex> SET <sql> ... DEFAULT SET <sql>``."""
    m = re.match(r"\s*EVALUATE\s+(\w+)(?:\s+ASSIGNING\s+EACH\s+([\s\S]*))?$", text.strip(), re.I)
    if not m:
        raise InvalidAssignment(text)
    cases, default = [], None
    for line in filter(None, (x.strip() for x in re.split(r"(?=\bCASE\b)|(?=\bDEFAULT\b)", m[2] or ""))):
        if c := re.match(r"CASE\s+(\S+)\s+SET\s+([\s\S]+)$", line, re.I):
            cases.append((c[1], c[2].strip()))
        elif d := re.match(r"DEFAULT\s+SET\s+([\s\S]+)$", line, re.I):
            default = d[1].strip()
        else:
            raise InvalidAssignment(line)
    return semiring(m[1]), Assignment(tuple(cases), default)


def _unfolded(query: Rule, definitions: list[Rule]) -> list[tuple[Rule, Tree]]:
    return distinct_rules(unfold(query, definitions))


def _labels(query: Rule) -> list[str]:
    from ..plans.compile import _names

    return list(_names(query.head))


def evaluate(query: Rule, definitions: list[Rule], tables: Mapping[str, DataFrame], ring: Semiring, assigned: Assignment = Assignment(), shape: Head | None = None) -> DataFrame:
    """Answers of ``query`` with their value in ``PROV__``, one row per answer."""
    parts = []
    for rule, _ in _unfolded(query, definitions):
        rows = body(rule, lambda a, i: resolve(tables, a.relation))
        values = []
        for atom in rule.positive():
            values.append(_value(rows, atom, value_columns(resolve(tables, atom.relation)), ring, assigned))
        value = reduce(ring.times, values)
        part = project(rows, rule.head, shape, distinct=False, more={COLUMN: value})
        parts.append(part.toDF(*_labels(query), COLUMN) if shape is None else part)
    together = reduce(DataFrame.unionByName, parts)
    by = [c for c in together.columns if c != COLUMN]
    return together.groupBy(*by).agg(ring.plus(COLUMN).alias(COLUMN))


def _value(rows, atom: Atom, columns: list[str], ring: Semiring, assigned: Assignment) -> Column:
    """A leaf's value in the joined rows: its columns are the terms that the rule bound."""
    text = assigned.expression(atom.relation)
    if text is None:
        if ring.default is None:
            raise InvalidAssignment(f"no value for {atom.relation}")
        return F.lit(ring.default).cast("bigint")
    named = dict(zip(columns, atom.args, strict=True))

    def sql(m: re.Match) -> str:
        t = named.get(m[1])
        if t is None:
            raise InvalidAssignment(f"{atom.relation} has no column {m[1]}")
        return f"`{t}`" if not hasattr(t, "value") else str(t)

    return F.expr(re.sub(r"\$\$\.(\w+)", sql, text))


def polynomial(query: Rule, definitions: list[Rule], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Answers with their provenance as text: ``m1(r(1,2) * s(2)) + m2(t(1))``."""
    parts = []
    for rule, tree in _unfolded(query, definitions):
        rows = body(rule, lambda a, i: resolve(tables, a.relation))
        atoms = rule.positive()

        def text(t: Tree) -> Column:
            if t.leaf is not None:
                args = [F.coalesce(rows.term(x)[0].cast("string"), *([rows.term(x)[1]] if rows.term(x)[1] is not None else []), F.lit("-")) for x in atoms[t.leaf].args]  # noqa: B023
                return F.concat(F.lit(t.label + "("), F.concat_ws(",", *args), F.lit(")"))
            return F.concat(F.lit(t.label + "("), F.concat_ws(" * ", *map(text, t.children)), F.lit(")"))  # noqa: B023

        top = F.concat_ws(" * ", *map(text, tree.children))
        parts.append(project(rows, rule.head, None, distinct=False, more={COLUMN: top}).toDF(*_labels(query), COLUMN))
    together = reduce(DataFrame.unionByName, parts)
    by = [c for c in together.columns if c != COLUMN]
    return together.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(COLUMN)), " + ").alias(COLUMN))
