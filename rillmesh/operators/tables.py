"""Housekeeping on named relations: migrate, clear, copy, move, mirror, examine, compare, count."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import Head, compile_rule, minus
from ..plans.rules import Rule, parse_rule
from ..storage import Stored
from . import relational


class TableSet:
    """Stored relations by name.  Every change binds a name to new immutable files."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        self._stored: dict[str, Stored] = {n: Stored.of(df, "table") for n, df in (tables or {}).items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._stored[name].df()

    def names(self) -> list[str]:
        return sorted(self._stored)

    def create(self, name: str, schema) -> None:
        self._stored[name] = Stored.empty(self.spark, self.spark.createDataFrame([], schema).schema)

    def create_with_companions(self, name: str, schema, kinds: tuple[str, ...] = ("_L", "_R", "_PREV")) -> None:
        """The relation, its local contributions, rejections and last snapshot."""
        for kind in ("", *kinds):
            self.create(name + kind, schema)

    def insert(self, name: str, rows: DataFrame) -> int:
        """Adds rows that are not there yet (set semantics); returns how many."""
        new = Stored.of(minus(rows.distinct(), self[name]), "ins")
        self._stored[name] = self._stored[name].plus(new)
        return new.df().count()

    def delete(self, name: str, rows: DataFrame) -> None:
        self._stored[name] = Stored.of(minus(self[name], rows), "table")

    def apply(self, rule: str | Rule) -> None:
        """Runs a rule as an update: its rows are added to the head, or, if the head is negated,
        removed from it."""
        rule = parse_rule(rule) if isinstance(rule, str) else rule
        tables = {n: self[n] for n in self.names()}
        target = self[rule.head.relation]
        rows = compile_rule(rule, tables, Head.of(target))
        if rule.head.negated:
            self.delete(rule.head.relation, rows)
        else:
            self.insert(rule.head.relation, rows)

    def replace(self, name: str, rows: DataFrame, replace_all: bool = True) -> None:
        """Imports rows, instead of or beside what is there."""
        self._stored[name] = Stored.of(rows if replace_all else self[name].unionByName(rows).distinct(), "table")

    def clear(self, name: str) -> None:
        self._stored[name] = Stored.empty(self.spark, self._stored[name].schema)

    def copy(self, source: str, target: str) -> None:
        """``target`` becomes the same files: nothing is rewritten."""
        self._stored[target] = self._stored[source]

    def move(self, source: str, target: str) -> None:
        self.copy(source, target)
        self.clear(source)

    mirror = copy

    def migrate(self, name: str) -> None:
        """Existing rows of a relation become its local contributions."""
        self.copy(name, name + "_L")

    def examine(self, name: str, rows: int = 20) -> list[tuple]:
        """Some rows, for a person to look at."""
        return [tuple(r) for r in self[name].limit(rows).collect()]

    def compare(self, a: str, b: str) -> int:
        return relational.difference_count(self[a], self[b])

    def counts(self) -> DataFrame:
        return relational.counts({n: self[n] for n in self.names()})


Predicate = Callable[..., "F.Column"]


class PredicateRegistry:
    """User predicates that may stand in join conditions.  A predicate builds a Catalyst column
    from columns; a Python function is wrapped as a vectorized UDF by its owner."""

    def __init__(self) -> None:
        self._known: dict[str, Predicate] = {}

    def register(self, name: str, predicate: Predicate) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered twice")
        self._known[name] = predicate

    def join(self, left: DataFrame, right: DataFrame, name: str, left_columns: list[str], right_columns: list[str], how: str = "inner", equal: list[str] | None = None) -> DataFrame:
        """Joins on a registered predicate; with ``equal`` (shared key columns) the join hashes on
        those and tests the predicate within a key, which is what makes it scale."""
        if how not in ("inner", "left", "right", "full"):
            raise ValueError(how)
        taken = set(left.columns)
        renamed = right.select(*[F.col(c).alias(f"r_{c}" if c in taken else c) for c in right.columns])
        names = {c: (f"r_{c}" if c in taken else c) for c in right.columns}
        test = self._known[name](*[left[c] for c in left_columns], *[renamed[names[c]] for c in right_columns])
        for c in equal or []:
            test = (left[c] == renamed[names[c]]) & test
        return left.join(renamed, test, how)
