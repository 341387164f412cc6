"""Least fixpoints of stratified programs, by delta propagation.

Programs are cut into strongly connected components; a component without recursion is one
query per head, a recursive one is a driver loop in which each round joins only what
the last round added.  For a rule with several atoms over changing relations, round by
round and atom by atom: atoms before the delta see the new state, atoms after it the
old one, so every combination is met exactly once.

Each round's new rows are written to the shared folder and the accumulated relation
is the list of those folders; plans keep their size and a lost executor costs at most one round.

A ``lean`` evaluation stores only rows of a recursive relation that some rule can join again
and derives all others when the relation is read, so a result much larger than what drives the
recursion is never kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..storage import Stored
from .compile import Head, body, minus, project, resolve, value_columns, within
from .rules import Atom, Const, Rule, RuleError, Var, canonical, minimized


def components(rules: list[Rule]) -> list[tuple[set[str], list[Rule], bool]]:
    """(heads, rules, recursive?) in evaluation order; negation inside one is an error."""
    heads = {r.head.relation for r in rules}
    edges: dict[str, set[str]] = defaultdict(set)
    for r in rules:
        edges[r.head.relation] |= {a.relation for a in (*r.positive(), *r.negative()) if a.relation in heads}
    order, index, low, stack, on = [], {}, {}, [], set()

    def visit(start: str) -> None:
        # Tarjan's algorithm with an explicit stack.
        work = [(start, iter(sorted(edges[start])))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, todo = work[-1]
            for n in todo:
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(sorted(edges[n]))))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    own = set()
                    while True:
                        n = stack.pop()
                        on.discard(n)
                        own.add(n)
                        if n == node:
                            break
                    order.append(own)

    for h in sorted(heads):
        if h not in index:
            visit(h)
    found = []
    for own in order:
        mine = [r for r in rules if r.head.relation in own]
        recursive = any(a.relation in own for r in mine for a in r.positive())
        for r in mine:
            if any(a.relation in own for a in r.negative()):
                raise RuleError(f"not stratified: {r}")
        found.append((own, mine, recursive))
    return found


#: An accumulator this many bytes large, and this many times larger than a round's delta, is
#: not shuffled to find what is new.
LARGE_BYTES, LARGE_RATIO = 256 << 20, 8


def _unseen(found: DataFrame, known: Stored, step: Mapping[str, Stored]) -> Stored:
    """Rows of ``found`` that ``known`` lacks.

    Normally one anti-join, which deals out both sides.  Where the accumulator dwarfs the last
    delta, the found rows are stored, the few accumulated rows equal to one of them are picked by
    a semi-join (whose small side adaptive execution broadcasts by its measured size), and the
    anti-join then meets only those.
    """
    size = known.bytes()
    if size < LARGE_BYTES or size < LARGE_RATIO * sum(s.bytes() for s in step.values()):
        return Stored.of(minus(found, known.df()), "delta")
    stored = Stored.of(found, "found").df()
    return Stored.of(minus(stored, within(known.df(), stored)), "delta")


def propagate(rules: list[Rule], full: Mapping[str, Stored], delta: Mapping[str, Stored], fixed: Mapping[str, DataFrame], shapes: Mapping[str, Head], rounds: int = 1000) -> tuple[dict[str, Stored], dict[str, Stored]]:
    """Adds ``delta`` to ``full`` and follows ``rules`` until nothing is new.

    ``full``: changing relations as they were; ``fixed``: all others.  Returns the new state
    and, by relation, everything that was added (``delta`` included).
    """
    rules = list({canonical(r): r for r in map(minimized, rules)}.values())
    old = dict(full)
    now = {n: old[n].plus(d) if n in old else d for n, d in delta.items()}
    state = {**old, **now}
    added = dict(delta)
    step = dict(delta)
    for _ in range(rounds):
        step = {n: d for n, d in step.items() if not d.is_empty()}
        if not step:
            return state, added
        before = {n: old[n].df() if n in old else None for n in state}
        after = {n: s.df() for n, s in state.items()}
        derived: dict[str, list[DataFrame]] = defaultdict(list)
        for r in rules:
            atoms = r.positive()
            for i, a in enumerate(atoms):
                if a.relation not in step:
                    continue

                def scan(atom, j, i=i):
                    if j == i:
                        return step[atom.relation].df()  # noqa: B023
                    if atom.relation in state:  # noqa: B023
                        if j > i and atom.relation in step:  # noqa: B023
                            was = before[atom.relation]  # noqa: B023
                            return was if was is not None else after[atom.relation].limit(0)  # noqa: B023
                        return after[atom.relation]  # noqa: B023
                    return resolve(fixed, atom.relation)

                derived[r.head.relation].append(project(body(r, scan, first=i), r.head, shapes[r.head.relation], distinct=False))
        old = dict(state)
        step, last = {}, step
        for n, parts in derived.items():
            found = parts[0]
            for p in parts[1:]:
                found = found.unionByName(p)
            found = found.distinct()
            new = _unseen(found, state[n], last) if n in state else Stored.of(found, "delta")
            if new.is_empty():
                continue
            step[n] = new
            state[n] = state[n].plus(new) if n in state else new
            added[n] = added[n].plus(new) if n in added else new
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


#: Names of the relations that a lean evaluation adds; no rule text can name them.
_CORE, _LEFT, _RIGHT, _DEMAND = "#core", "#left", "#right", "#demand"


def _columns(rule: Rule, known: Mapping[str, DataFrame], shape: Head | None = None) -> DataFrame:
    return project(body(rule, lambda a, i: resolve(known, a.relation)), rule.head, shape, distinct=False)


def _demands(rules: list[Rule], head: str, known: Mapping[str, DataFrame]) -> list[list[tuple[tuple[int, ...], str, DataFrame]]] | None:
    """What rows of ``head`` each of its atoms in ``rules`` can join: for every other atom that shares variables with it,
    positions and a table of the values there.  None if some atom can join any row."""
    found = []
    for r in rules:
        for a in (x for x in r.positive() if x.relation == head):
            mine = []
            for b in (x for x in r.positive() if x.relation != head):
                shared = [v for v in dict.fromkeys(b.variables()) if v in a.args]
                if shared:
                    values = _columns(Rule(Atom(_DEMAND, tuple(shared)), (b,)), known).distinct()
                    mine.append((tuple(a.args.index(v) for v in shared), f"{_DEMAND}{len(found)}.{len(mine)}", values))
            if not mine:
                return None
            found.append(mine)
    return found


def _factors(rule: Rule, fixed: Mapping[str, DataFrame]) -> dict[tuple, tuple[Rule, Rule, tuple[int, ...]]]:
    """Ways to see ``rule`` as a join of two parts, one of them a single atom that alone gives some of the head's
    variables: by what that atom is like, a rule for either part and the head's positions that the atom gives."""
    found = {}
    head = rule.head.args
    if not all(isinstance(t, Var) for t in head) or len(set(head)) < len(head):
        return found
    for a in rule.positive():
        rest = tuple(x for x in rule.body if x is not a)
        elsewhere = {v for x in rest for v in x.variables()}
        own = [v for v in dict.fromkeys(a.variables()) if v in head and v not in elsewhere]
        on = [v for v in dict.fromkeys(a.variables()) if v in elsewhere]
        bound = {v for x in Rule(rule.head, rest).positive() for v in x.variables()}
        if a.relation not in fixed or not own or not on or not bound.issuperset(on) or not all(isinstance(t, (Var, Const)) for t in a.args):
            continue
        kind = tuple((repr(t.value),) if isinstance(t, Const) else (head.index(t),) if t in own else ("on", on.index(t)) if t in on else ("_", a.args.index(t)) for t in a.args)
        left = Rule(Atom(_LEFT, (*[v for v in head if v not in own], *on)), rest)
        found[(a.relation, kind)] = (left, Rule(Atom(_RIGHT, (*own, *on)), (a,)), tuple(head.index(v) for v in own))
    return found


def _derived(rules: list[Rule], known: Mapping[str, DataFrame], fixed: Mapping[str, DataFrame], shape: Head) -> DataFrame:
    """Distinct rows of ``rules`` (one head) without shuffling what they derive, where all are joins with one atom.

    Distinct rows of the left part meet distinct rows of the right one.  A right row whose head values
    stand in no other right row then gives no row twice; only those of the others need be made distinct."""
    ways = [_factors(r, fixed) for r in rules]
    common = [k for k in ways[0] if all(k in w for w in ways)]
    if not common:
        return _united([_columns(r, known, shape) for r in rules]).distinct()
    parts = [w[common[0]] for w in ways]
    lefts = [_columns(left, known) for left, _, _ in parts]
    right = _columns(parts[0][1], known)
    if len({tuple(t for _, t in x.dtypes) for x in lefts}) > 1 or any(value_columns(x) != x.columns for x in (*lefts, right)):
        return _united([_columns(r, known, shape) for r in rules]).distinct()
    names = [f"c{i}" for i in range(len(lefts[0].columns))]
    left = Stored.of(_united([x.toDF(*names) for x in lefts]).distinct(), "left").df()
    right = Stored.of(right.toDF(*[f"d{i}" for i in range(len(right.columns))]).distinct(), "right").df()
    at = parts[0][2]
    own, n = [Var(f"y{i}") for i in range(len(at))], len(shape.columns) - len(at)
    kept, on = [Var(f"x{i}") for i in range(n)], [Var(f"z{i}") for i in range(len(names) - n)]
    given, others = dict(zip(at, own, strict=True)), iter(kept)
    head = Atom("ans", tuple(given[i] if i in given else next(others) for i in range(len(shape.columns))))
    rule = Rule(head, (Atom(_LEFT, (*kept, *on)), Atom(_RIGHT, (*own, *on))))
    values = right.columns[: len(own)]
    counts = right.groupBy(*values).count()
    once, often = (_columns(rule, {_LEFT: left, _RIGHT: within(right, counts.where(f"count {test} 1").drop("count"), values)}, shape) for test in ("=", ">"))
    return once.unionByName(often.distinct())


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lean(head: str, rules: list[Rule], known: Mapping[str, DataFrame], shape: Head, rounds: int) -> DataFrame | None:
    """The rows of a recursive relation of which only those are stored that a rule can join again; None where that can't be said."""
    fixed = {k: v for k, v in known.items() if k != head}
    rest = [r for r in rules if any(a.relation == head for a in r.positive())]
    demands = None if head in known or shape.labeled else _demands(rest, head, fixed)
    if demands is None:
        return None
    core, tables, made = f"{head}{_CORE}", dict(fixed), []
    for mine in demands:
        tables |= {name: Stored.of(values, "demand").df() for _, name, values in mine}
    named = lambda x: Atom(core, x.args) if isinstance(x, Atom) and x.relation == head else x
    for r in rules:
        # Demands are put on the head's variables; they compare what the head holds only if it holds it unchanged.
        plain = _columns(Rule(r.head, tuple(x for x in r.body if x not in r.negative())), {**tables, head: _no_rows(shape, next(iter(fixed.values())).sparkSession)})
        if not all(isinstance(t, Var) for t in r.head.args) or value_columns(plain) != plain.columns or [t for _, t in plain.dtypes] != [(shape.types or {}).get(c) for c in shape.columns]:
            return None
        for mine in demands:
            wanted = tuple(Atom(name, tuple(r.head.args[i] for i in at)) for at, name, _ in mine)
            made.append(Rule(Atom(core, r.head.args), (*wanted, *map(named, r.body))))
    tables[core] = evaluate(made, tables, {core: shape}, rounds)[core]
    final = list({canonical(r): r for r in map(minimized, [Rule(r.head, tuple(map(named, r.body))) for r in rules])}.values())
    return _derived(final, tables, fixed, shape)


def _no_rows(shape: Head, spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c}` {(shape.types or {}).get(c, 'string')}" for c in shape.columns))


def evaluate(rules: list[Rule], tables: Mapping[str, DataFrame], shapes: Mapping[str, Head] | None = None, rounds: int = 1000, lean: bool = False) -> dict[str, DataFrame]:
    """All head relations of a stratified program over ``tables``; a head that is also a
    table starts from that table's rows.  ``lean``: recursive relations store only what drives
    the recursion, where their rules tell it, and derive the rest anew each time they are read."""
    shapes = dict(shapes or {})
    known: dict[str, DataFrame] = dict(tables)
    out: dict[str, DataFrame] = {}
    for own, mine, recursive in components(rules):
        _type_heads(own, mine, known, shapes)
        if not recursive:
            (h,) = own
            parts = [project(body(r, lambda a, i: resolve(known, a.relation)), r.head, shapes[h], distinct=False) for r in {canonical(r): r for r in map(minimized, mine)}.values()]
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            if h in known:
                df = df.unionByName(known[h])
            known[h] = out[h] = df.distinct()
            continue
        if lean and len(own) == 1:
            (h,) = own
            found = _lean(h, mine, known, shapes[h], rounds)
            if found is not None:
                known[h] = out[h] = found
                continue
        seeds: dict[str, list[DataFrame]] = defaultdict(list)
        rest = []
        for r in mine:
            if any(a.relation in own for a in r.positive()):
                rest.append(r)
            else:
                seeds[r.head.relation].append(project(body(r, lambda a, i: resolve(known, a.relation)), r.head, shapes[r.head.relation], distinct=False))
        start: dict[str, Stored] = {}
        for h in own:
            parts = seeds[h] + ([known[h]] if h in known else [])
            if parts:
                df = parts[0]
                for p in parts[1:]:
                    df = df.unionByName(p)
                start[h] = Stored.of(df.distinct(), "seed")
        if not start:
            raise RuleError(f"no rule grounds {sorted(own)}")
        spark = next(iter(start.values())).spark
        schema = {h: s.schema for h, s in start.items()}
        full = {}
        for h in own - set(start):
            full[h] = Stored.empty(spark, _schema_of(shapes[h], next(iter(schema.values()))))
        fixed = {k: v for k, v in known.items() if k not in own}
        for name in {a.relation for r in rest for a in (*r.positive(), *r.negative())} & set(fixed):
            # Every round reads it again: what takes a shuffle to compute is computed once.
            if "Exchange" in fixed[name]._jdf.queryExecution().executedPlan().toString():
                fixed[name] = known[name] = Stored.of(fixed[name], "fixed").df()
        state, _ = propagate(rest, full, start, fixed, shapes, rounds)
        for h in own:
            known[h] = out[h] = state[h].df()
    return out


def _schema_of(shape: Head, like):
    """A schema for a relation without seeds, from its shape's types."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    text = ", ".join(f"`{c}` {(shape.types or {}).get(c, 'string')}" + (f", `{c}_LN` string" if c in shape.labeled else "") for c in shape.columns)
    return StructType(_parse_datatype_string(text).fields)


def _type_heads(own: set[str], rules: list[Rule], known: Mapping[str, DataFrame], shapes: dict[str, Head]) -> None:
    """Shapes of undeclared heads, each from the first rule whose body can be typed; heads
    typed so far stand for their relations."""
    probes: dict[str, DataFrame] = dict(known)
    missing = []
    for h in sorted(own):
        if h in known:
            shapes.setdefault(h, Head.of(known[h]))
        elif h not in shapes:
            missing.append(h)
    while missing:
        done = []
        for h in missing:
            for r in rules:
                if r.head.relation == h and all(a.relation in probes or any(k.endswith("." + a.relation) for k in probes) for a in r.positive()):
                    row = project(body(Rule(r.head, tuple(x for x in r.body if x not in r.negative())), lambda a, i: resolve(probes, a.relation)), r.head, distinct=False)
                    shapes[h], probes[h] = Head.of(row), row.limit(0)
                    done.append(h)
                    break
        if not done:
            raise RuleError(f"cannot type {missing}")
        missing = [h for h in missing if h not in done]
