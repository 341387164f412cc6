"""From a rule to one DataFrame expression.

Every atom becomes a projected and filtered scan whose columns are named by its variables;
atoms are joined on the variables they share, in an order that avoids products where it
can; functions add columns, comparisons filter as soon as their variables are bound, and
negated atoms are left-anti joins.  Catalyst pushes the filters and projections into the scans
and picks each join's strategy; there are no hints here, as sizes are not known.

Null rules: SQL null never joins; a labeled null joins with itself (same label).  Negation
and tuple identity are null-safe.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import builtins
from ..functions.skolem import SUFFIX, label
from .rules import Atom, Comparison, Const, Labeled, Rule, RuleError, Skolem, Term, Var, check_safe

_LABEL = "#ln"  # companion of a variable's column while a rule is being joined


def value_columns(df: DataFrame) -> list[str]:
    """Columns without the companions of others."""
    names = set(df.columns)
    return [c for c in df.columns if not (c.endswith(SUFFIX) and c[: -len(SUFFIX)] in names)]


def identical(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs of two DataFrames."""
    return reduce(operator.and_, [left[a].eqNullSafe(right[b]) for a, b in pairs], F.lit(True))


def minus(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` without an identical row in ``right`` (columns ``on``, or all)."""
    on = on or left.columns
    other = right.select(*[F.col(c).alias(f"__r_{c}") for c in on])
    return left.join(other, identical(left, other, [(c, f"__r_{c}") for c in on]), "left_anti")


def within(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` with an identical row in ``right``."""
    on = on or left.columns
    other = right.select(*[F.col(c).alias(f"__r_{c}") for c in on])
    return left.join(other, identical(left, other, [(c, f"__r_{c}") for c in on]), "left_semi")


@dataclass
class _Joined:
    """Rows so far: a column per variable, and one more per variable that may be labeled."""

    df: DataFrame
    bound: dict[str, bool]  # variable -> has a companion

    def value(self, v: str) -> Column:
        return self.df[f"`{v}`"]

    def companion(self, v: str) -> Column | None:
        return self.df[f"`{v}{_LABEL}`"] if self.bound[v] else None

    def term(self, t: Term) -> tuple[Column, Column | None]:
        if isinstance(t, Var):
            if t.name not in self.bound:
                raise RuleError(f"unbound variable {t.name}")
            return self.value(t.name), self.companion(t.name)
        if isinstance(t, Const):
            return F.lit(t.value), None
        if isinstance(t, Labeled):
            return F.lit(None), F.lit(t.label)
        return F.lit(None), label(t.function, [self.term(a) for a in t.args])


def _scan(df: DataFrame, atom: Atom) -> _Joined:
    """One atom: constants and repeated variables filter, variables name columns."""
    columns, names = value_columns(df), set(df.columns)
    if len(columns) != len(atom.args):
        raise RuleError(f"{atom.relation} has {len(columns)} columns, not {len(atom.args)}")
    companion = {c: F.col(f"`{c}{SUFFIX}`") if c + SUFFIX in names else None for c in columns}
    tests: list[Column] = []
    seen: dict[str, str] = {}
    for c, t in zip(columns, atom.args, strict=True):
        col, ln = F.col(f"`{c}`"), companion[c]
        if isinstance(t, Const):
            if t.value is None:
                tests += [col.isNull(), *([ln.isNull()] if ln is not None else [])]
            else:
                tests += [col == F.lit(t.value), *([ln.isNull()] if ln is not None else [])]
        elif isinstance(t, Labeled):
            tests.append(ln == F.lit(t.label) if ln is not None else F.lit(False))
        elif isinstance(t, Skolem):
            raise RuleError("a Skolem term cannot be matched in a body")
        elif t.name in seen:
            first = seen[t.name]
            tests.append(_same((F.col(f"`{first}`"), companion[first]), (col, ln)))
        else:
            seen[t.name] = c
    for test in tests:
        df = df.where(test)
    bound = {v: all(companion[c] is not None for c, t in zip(columns, atom.args, strict=True) if isinstance(t, Var) and t.name == v) for v in seen}
    kept = [F.col(f"`{c}`").alias(v) for v, c in seen.items()] + [companion[c].alias(v + _LABEL) for v, c in seen.items() if bound[v]]
    return _Joined(df.select(*kept) if kept else df.select(F.lit(1).alias("__one")).limit(1), bound)


def _same(a: tuple[Column, Column | None], b: tuple[Column, Column | None]) -> Column:
    """SQL equality of two terms: equal values, or equal labels."""
    (av, al), (bv, bl) = a, b
    if al is None and bl is None:
        return av == bv
    if al is None or bl is None:
        return (av == bv) & (al if al is not None else bl).isNull()
    # Two null-safe equi-join keys, so values of different numeric types meet as they do elsewhere; rows
    # with neither value nor label never match.
    return av.eqNullSafe(bv) & al.eqNullSafe(bl) & (av.isNotNull() | al.isNotNull())


def _aliased(side: _Joined, tag: str) -> _Joined:
    """Columns renamed by ``tag`` so a join has no ambiguous name."""
    return _Joined(side.df.select(*[F.col(f"`{c}`").alias(f"{tag}{c}") for c in side.df.columns]), side.bound)


def _join(left: _Joined, right: _Joined) -> _Joined:
    shared = [v for v in right.bound if v in left.bound]
    tagged = _aliased(right, "r#")

    def of_right(v: str) -> tuple[Column, Column | None]:
        return tagged.df[f"`r#{v}`"], tagged.df[f"`r#{v}{_LABEL}`"] if right.bound[v] else None

    if shared:
        on = reduce(operator.and_, [_same((left.value(v), left.companion(v)), of_right(v)) for v in shared])
        df = left.df.join(tagged.df, on, "inner")
    else:
        df = left.df.crossJoin(tagged.df)
    # Equal to an ordinary value means ordinary: the companion is no longer needed.
    bound = {v: ln and right.bound.get(v, True) for v, ln in left.bound.items()} | {v: ln for v, ln in right.bound.items() if v not in left.bound}
    kept = [F.col(f"`{c}`") for c in left.df.columns if c != "__one"]
    for v, ln in right.bound.items():
        if v not in left.bound:
            kept += [F.col(f"`r#{v}`").alias(v), *([F.col(f"`r#{v}{_LABEL}`").alias(v + _LABEL)] if ln else [])]
    return _Joined(df.select(*kept) if kept else df, bound)


def _order(atoms: list[tuple[int, Atom]], first: int | None) -> list[int]:
    """Positions in join order: ``first`` (a delta) leads, then always an atom that shares a
    variable with what is joined, preferring those with most shared variables and constants."""
    left = dict(atoms)
    order: list[int] = []
    bound: set[Var] = set()

    def weight(i: int) -> tuple:
        own = set(left[i].variables())
        return (len(own & bound), sum(isinstance(t, Const) for t in left[i].args), -i)

    while left:
        i = first if first in left else max(left, key=weight)
        first = None
        order.append(i)
        bound |= set(left.pop(i).variables())
    return order


Scan = Callable[[Atom, int], DataFrame]


def body(rule: Rule, scan: Scan, first: int | None = None) -> _Joined:
    """The rule's firings with a column per variable; ``scan(atom, i)`` gives the rows of
    the i-th positive atom (i is -1 for negated ones)."""
    check_safe(rule)
    atoms = list(enumerate(rule.positive()))
    todo_f, todo_c = list(rule.functions()), list(rule.comparisons())
    by_position = dict(atoms)
    rows: _Joined | None = None
    for i in _order(atoms, first):
        part = _scan(scan(by_position[i], i), by_position[i])
        rows = part if rows is None else _join(rows, part)
        rows = _apply(rows, todo_f, todo_c)
    if rows is None:
        raise RuleError(f"no positive atom in {rule}")
    if todo_f or todo_c:
        raise RuleError(f"unbound function or comparison in {rule}")
    for atom in rule.negative():
        rows = _negate(rows, scan(atom, -1), atom)
    return rows


def _apply(rows: _Joined, functions: list[Atom], comparisons: list[Comparison]) -> _Joined:
    """Functions and comparisons whose inputs are bound by now."""
    moved = True
    while moved:
        moved = False
        for f in list(functions):
            compare = f.relation.upper().startswith("COMPARE.")
            inputs = f.args if compare else f.args[1:]
            if any(v.name not in rows.bound for t in inputs for v in ([t] if isinstance(t, Var) else [])):
                continue
            call = builtins.lookup(f.relation, len(inputs))(*[rows.term(t)[0] for t in inputs])
            functions.remove(f)
            moved = True
            if compare:
                rows = _Joined(rows.df.where(call), rows.bound)
            elif isinstance(f.args[0], Var) and f.args[0].name not in rows.bound:
                name = f.args[0].name
                rows = _Joined(rows.df.withColumn(name, call), rows.bound | {name: False})
            else:
                rows = _Joined(rows.df.where(call == rows.term(f.args[0])[0]), rows.bound)
    for c in list(comparisons):
        if all(v.name in rows.bound for v in c.variables()):
            comparisons.remove(c)
            (a, al), (b, bl) = rows.term(c.left), rows.term(c.right)
            test = _same((a, al), (b, bl)) if c.op == "=" else builtins.COMPARISONS[c.op](a, b)
            rows = _Joined(rows.df.where(test), rows.bound)
    return rows


def _negate(rows: _Joined, df: DataFrame, atom: Atom) -> _Joined:
    """Rows without a match in ``df``; variables that only the atom has match anything."""
    # A Skolem term is computed first, so it can be compared like a variable.
    args: list[Term] = []
    for k, t in enumerate(atom.args):
        if isinstance(t, Skolem):
            name = f"#s{k}"
            columns = rows.df.columns
            df_ = rows.df.select(*[F.col(f"`{c}`") for c in columns if c not in (name, name + _LABEL)], F.lit(None).cast("string").alias(name), rows.term(t)[1].alias(name + _LABEL))
            rows = _Joined(df_, rows.bound | {name: True})
            t = Var(name)
        args.append(t)
    atom = Atom(atom.relation, tuple(args), atom.negated)
    known = [v for v in dict.fromkeys(atom.variables()) if v.name in rows.bound]
    part = _aliased(_scan(df, atom), "n#")
    tests = []
    for v in known:
        tests.append(rows.value(v.name).eqNullSafe(part.df[f"`n#{v.name}`"]))
        mine, theirs = rows.companion(v.name), part.df[f"`n#{v.name}{_LABEL}`"] if part.bound[v.name] else None
        if mine is not None or theirs is not None:
            tests.append((mine if mine is not None else F.lit(None)).eqNullSafe(theirs if theirs is not None else F.lit(None)))
    if not tests:
        return _Joined(rows.df.join(part.df.limit(1), F.lit(True), "left_anti"), rows.bound)
    return _Joined(rows.df.join(part.df, reduce(operator.and_, tests), "left_anti"), rows.bound)


@dataclass(frozen=True)
class Head:
    """Columns of a head relation: names, types (or None) and which carry companions."""

    columns: tuple[str, ...]
    labeled: frozenset[str] = frozenset()
    types: Mapping[str, str] | None = None

    @classmethod
    def of(cls, df: DataFrame) -> Head:
        cs = value_columns(df)
        return cls(tuple(cs), frozenset(c for c in cs if c + SUFFIX in df.columns), {c: df.schema[c].dataType.simpleString() for c in cs})


def project(rows: _Joined, head: Atom, shape: Head | None = None, distinct: bool = True, more: Mapping[str, Column] | None = None) -> DataFrame:
    """The head's columns; Skolem terms fill companions, null constants are typed."""
    names = shape.columns if shape else tuple(_names(head))
    if len(names) != len(head.args):
        raise RuleError(f"{head.relation} has {len(names)} columns, not {len(head.args)}")
    kept: list[Column] = []
    for name, t in zip(names, head.args, strict=True):
        value, companion = rows.term(t)
        if shape and shape.types:
            value = value.cast(shape.types[name])
        elif isinstance(t, (Skolem, Labeled)) or (isinstance(t, Const) and t.value is None):
            value = value.cast("string")
        kept.append(value.alias(name))
        if name in shape.labeled if shape else companion is not None:
            kept.append((companion if companion is not None else F.lit(None)).cast("string").alias(name + SUFFIX))
        elif companion is not None:
            raise RuleError(f"{head.relation}.{name} may hold a labeled null but has no companion")
    kept += [c.alias(n) for n, c in (more or {}).items()]
    df = rows.df.select(*kept)
    return df.distinct() if distinct else df


def _names(head: Atom) -> list[str]:
    """Column names of a head that has no declared relation: its variables, else c<i>."""
    names: list[str] = []
    for i, t in enumerate(head.args):
        name = t.name if isinstance(t, Var) and t.name not in names else f"c{i}"
        names.append(name)
    return names


def compile_rule(rule: Rule, tables: Mapping[str, DataFrame], shape: Head | None = None, distinct: bool = True) -> DataFrame:
    """The rows that ``rule`` derives from ``tables``."""
    return project(body(rule, lambda a, i: resolve(tables, a.relation)), rule.head, shape, distinct)


def resolve(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """A table by full name or by an unambiguous suffix of it (``schema.rel``, ``rel``)."""
    if name in tables:
        return tables[name]
    found = [k for k in tables if k.endswith("." + name)]
    if len(found) != 1:
        raise RuleError(f"{'ambiguous' if found else 'unknown'} relation {name}")
    return tables[found[0]]


def union(rules: list[Rule], tables: Mapping[str, DataFrame], shape: Head | None = None, distinct: bool = True) -> DataFrame:
    """Rules with one head as one query; rules equal up to names are evaluated once."""
    from .rules import canonical, minimized

    unique = list({canonical(r): r for r in map(minimized, rules)}.values()) if distinct else rules
    parts = [compile_rule(r, tables, shape, distinct=False) for r in unique]
    out = parts[0]
    for p in parts[1:]:
        p = p.toDF(*out.columns) if p.columns != out.columns and len(p.columns) == len(out.columns) else p
        out = out.unionByName(p)
    return out.distinct() if distinct else out
