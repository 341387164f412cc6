"""Update exchange: what every peer sees after the mappings have run.

Per relation there are local contributions (``_L``), rejections (``_R``) and the relation itself; per
mapping there is a provenance relation with one row per firing.  ``recompute`` runs all rules
to their fixpoint; ``insert`` follows new local rows only; ``delete`` removes everything that a
deletion may reach and brings back what still has support, so tuples that only support each
other in a cycle disappear.  All three give the same state for the same local rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skolem import SUFFIX
from ..plans import mappings as maps
from ..plans.catalog import System, aligned
from ..plans.compile import _LABEL, Head, _Joined, minus, project, within
from ..plans.fixpoint import propagate
from ..plans.rules import Atom, Rule, RuleError, Tgd
from ..storage import Stored


@dataclass
class State:
    """Stored rows by relation: ``local``, ``rejected``, ``full`` (relations and provenance)."""

    local: dict[str, Stored] = field(default_factory=dict)
    rejected: dict[str, Stored] = field(default_factory=dict)
    full: dict[str, Stored] = field(default_factory=dict)


class Exchange:
    """The compiled mappings of a system and the operations on its state."""

    def __init__(self, spark: SparkSession, system: System, rejections: bool = True, check_acyclic: bool = True):
        self.spark, self.system, self.rejections = spark, system, rejections
        declared = [maps.qualified(system, m) for m in system.mappings]
        tgds = maps.composed(maps.with_inverses(declared), {system.find(v).full for v in system.virtual})
        if check_acyclic and not maps.weakly_acyclic(tgds):
            raise RuleError("the mappings are not weakly acyclic: the exchange may not end")
        self.tgds: list[Tgd] = tgds
        self.labeled = maps.labeled_positions(tgds)
        self.splits = [maps.split(m, i) for i, m in enumerate(tgds)]
        self.shapes: dict[str, Head] = {}
        for full, r in system.relations.items():
            own = frozenset(f.name for i, f in enumerate(r.fields) if (full, i) in self.labeled)
            self.shapes[full] = r.head(own)
        for s in self.splits:
            self.shapes[s.provenance] = self._provenance_shape(s)
        self.rules = [s.source for s in self.splits] + [t for s in self.splits for t in map(self._guarded, s.targets)]

    def _guarded(self, target: Rule) -> Rule:
        """A derived row is kept out where its peer has rejected it."""
        if not self.rejections:
            return target
        return Rule(target.head, (*target.body, Atom(target.head.relation + maps.REJECTED, target.head.args, negated=True)), target.name)

    def struct(self, full: str):
        return self.system.relations[full].struct(self.shapes[full].labeled)

    def _provenance_shape(self, s: maps.Split) -> Head:
        types, labeled = {}, set()
        for v in s.variables:
            places = [(a.relation, i) for a in s.body_atoms for i, t in enumerate(a.args) if t == v]
            if not places:
                types[v.name] = "double" if "DBL" in str(s.source) else "bigint"
                continue
            relation, i = places[0]
            f = self.system.relations[relation].fields[i]
            from ..plans.catalog import spark_type

            types[v.name] = spark_type(f.type).simpleString()
            if all(p in self.labeled for p in places):
                labeled.add(v.name)
        return Head(tuple(v.name for v in s.variables), frozenset(labeled), types)

    # ------------------------------------------------------------ state

    def start(self, local: Mapping[str, DataFrame], rejected: Mapping[str, DataFrame] | None = None) -> State:
        """A state with local rows and rejections, before any mapping has run."""
        state = State()
        for full in self.system.relations:
            given = next((df for n, df in local.items() if self.system.find(n).full == full), None)
            state.local[full] = Stored.of(aligned(given, self.struct(full)).distinct(), "local") if given is not None else Stored.empty(self.spark, self.struct(full))
            no = next((df for n, df in (rejected or {}).items() if self.system.find(n).full == full), None)
            state.rejected[full] = Stored.of(aligned(no, self.struct(full)).distinct(), "rejected") if no is not None else Stored.empty(self.spark, self.struct(full))
        return state

    def _fixed(self, state: State) -> dict[str, DataFrame]:
        fixed = {full + maps.REJECTED: s.df() for full, s in state.rejected.items()}
        fixed |= {full: Stored.empty(self.spark, self.struct(full)).df() for full in self.system.relations}
        return fixed

    def recompute(self, state: State) -> State:
        """All rules from the local rows up: the reference state for the incremental ways."""
        delta = {full: s for full, s in state.local.items() if s.parts}
        full, _ = propagate(self.rules, {}, delta, self._fixed(state), self.shapes)
        return State(state.local, state.rejected, full)

    def rows(self, state: State, name: str) -> DataFrame:
        full = self.system.find(name).full if not name.startswith("PROV.") else name
        if full in state.full:
            return state.full[full].df()
        return Stored.empty(self.spark, self.struct(full)).df()

    def derivable(self, state: State, name: str, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` that a firing of some mapping has as its head, rejected or not."""
        full = self.system.find(name).full
        rows = aligned(rows, self.struct(full))
        heads = [self._tuples(s, h, state.full[s.provenance].df()) for s in self.splits if s.provenance in state.full for h in s.heads if h.relation == full]
        return within(rows, reduce(DataFrame.unionByName, heads)) if heads else rows.limit(0)

    def changed(self, state: State, inserted: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame], rejected: Mapping[str, DataFrame] | None = None) -> State:
        """Local rows and rejections with a batch's deletions and then its insertions, before any mapping has run:
        what :meth:`recompute` takes where nothing is to be followed step by step."""
        local, no = dict(state.local), dict(state.rejected)
        named = lambda frames: {self.system.find(n).full: aligned(df, self.struct(self.system.find(n).full)).distinct() for n, df in (frames or {}).items()}
        for full, df in named(deleted).items():
            local[full] = Stored.of(minus(local[full].df(), df), "local")
        for full, df in named(rejected).items():
            no[full] = no[full].plus(Stored.of(minus(minus(df, local[full].df()), no[full].df()), "rej"))
        for full, df in named(inserted).items():
            new = Stored.of(minus(df, local[full].df()), "ins")
            local[full] = local[full].plus(new)
            no[full] = Stored.of(minus(no[full].df(), new.df()), "rejected")
        return State(local, no)

    # ------------------------------------------------------------ insertions

    def insert(self, state: State, inserted: Mapping[str, DataFrame]) -> State:
        """Adds local rows and follows only what they newly derive.  A row that its peer had
        rejected is no longer rejected."""
        local, rejected, delta = dict(state.local), dict(state.rejected), {}
        for name, df in inserted.items():
            full = self.system.find(name).full
            new = Stored.of(minus(aligned(df, self.struct(full)).distinct(), state.local[full].df()), "ins")
            local[full] = local[full].plus(new)
            if rejected[full].parts:
                rejected[full] = Stored.of(minus(rejected[full].df(), new.df()), "rejected")
            known = state.full.get(full)
            fresh = Stored.of(minus(new.df(), known.df()), "ins") if known is not None else new
            if not fresh.is_empty():
                delta[full] = fresh
        after = State(local, rejected, dict(state.full))
        if delta:
            after.full, _ = propagate(self.rules, state.full, delta, self._fixed(after), self.shapes)
        return after

    # ------------------------------------------------------------ deletions

    def _atom_columns(self, s: maps.Split, atom: Atom, prov: DataFrame) -> DataFrame:
        """Rows of ``prov`` with the tuple that ``atom`` matched, as columns ``@<column>``."""
        bound = {v.name: v.name + SUFFIX in prov.columns for v in s.variables}
        renamed = prov.select(*[F.col(f"`{v.name}`") for v in s.variables], *[F.col(f"`{v}{SUFFIX}`").alias(v + _LABEL) for v, b in bound.items() if b])
        shape = self.shapes[atom.relation]
        rows = _Joined(renamed, bound)
        keep = {c: F.col(f"`{c}`") for c in renamed.columns}
        out = project(rows, Atom(atom.relation, atom.args), Head(tuple("@" + c for c in shape.columns), frozenset("@" + c for c in shape.labeled), {"@" + c: t for c, t in (shape.types or {}).items()}), distinct=False, more={"#" + c: col for c, col in keep.items()})
        return out

    def _tagged(self, s: maps.Split, atom: Atom, rows: DataFrame, more: list[str]) -> DataFrame:
        """Firings with the tuple of ``atom`` as ``@`` columns, their own columns and ``more``."""
        bound = {v.name: v.name + SUFFIX in rows.columns for v in s.variables}
        inner = rows.withColumnsRenamed({v + SUFFIX: v + _LABEL for v, b in bound.items() if b})
        shape = self.shapes[atom.relation]
        keep = {c.replace(_LABEL, SUFFIX): F.col(f"`{c}`") for c in inner.columns}
        return project(_Joined(inner, bound), atom, Head(tuple("@" + c for c in shape.columns), frozenset("@" + c for c in shape.labeled), {"@" + c: t for c, t in (shape.types or {}).items()}), distinct=False, more=keep)

    def _prov_back(self, s: maps.Split, tagged: DataFrame) -> DataFrame:
        shape = self.shapes[s.provenance]
        cols = []
        for v in shape.columns:
            cols.append(F.col(f"`#{v}`").alias(v))
            if v in shape.labeled:
                cols.append(F.col(f"`#{v}{_LABEL}`").alias(v + SUFFIX))
        return tagged.select(*cols)

    def _tuples(self, s: maps.Split, atom: Atom, prov: DataFrame) -> DataFrame:
        """The tuples of ``atom`` that rows of ``prov`` name."""
        tagged = self._atom_columns(s, atom, prov)
        return tagged.select(*[F.col(f"`@{c}`").alias(c) for c in self.struct(atom.relation).names])

    def _matching(self, s: maps.Split, atom: Atom, prov: DataFrame, tuples: DataFrame, keep: bool = True) -> DataFrame:
        """Rows of ``prov`` whose ``atom`` tuple is (not) among ``tuples``."""
        tagged = self._atom_columns(s, atom, prov)
        names = self.struct(atom.relation).names
        other = tuples.select(*[F.col(c).alias(f"__t_{c}") for c in names])
        on = reduce(lambda a, b: a & b, [tagged[f"`@{c}`"].eqNullSafe(other[f"__t_{c}"]) for c in names])
        return self._prov_back(s, tagged.join(other, on, "left_semi" if keep else "left_anti"))

    def delete(self, state: State, deleted: Mapping[str, DataFrame], rejected: Mapping[str, DataFrame] | None = None) -> State:
        """Removes local rows (and adds rejections), then everything that loses its support."""
        local, no = dict(state.local), dict(state.rejected)
        suspect: dict[str, Stored] = {}
        for name, df in deleted.items():
            full = self.system.find(name).full
            gone = within(aligned(df, self.struct(full)).distinct(), state.local[full].df())
            gone = Stored.of(gone, "del")
            local[full] = Stored.of(minus(state.local[full].df(), gone.df()), "local")
            suspect[full] = gone
        for name, df in (rejected or {}).items():
            full = self.system.find(name).full
            new = Stored.of(minus(aligned(df, self.struct(full)).distinct(), local[full].df()), "rej")
            no[full] = no[full].plus(new)
            if full in state.full:
                hit = Stored.of(within(new.df(), state.full[full].df()), "rej")
                suspect[full] = suspect[full].plus(hit) if full in suspect else hit
        # What a deletion may reach: firings that used a suspect, and heads of those firings.
        reached = dict(suspect)
        dead_prov: dict[str, Stored] = {}
        step = dict(suspect)
        while step := {n: d for n, d in step.items() if not d.is_empty()}:
            following: dict[str, list[DataFrame]] = {}
            for s in self.splits:
                if s.provenance not in state.full:
                    continue
                prov = state.full[s.provenance].df()
                hits = [self._matching(s, a, prov, step[a.relation].df()) for a in s.body_atoms if a.relation in step]
                if not hits:
                    continue
                hit = reduce(DataFrame.unionByName, hits).distinct()
                if s.provenance in dead_prov:
                    hit = minus(hit, dead_prov[s.provenance].df())
                fresh = Stored.of(hit, "deadprov")
                if fresh.is_empty():
                    continue
                dead_prov[s.provenance] = dead_prov[s.provenance].plus(fresh) if s.provenance in dead_prov else fresh
                for h in s.heads:
                    following.setdefault(h.relation, []).append(self._tuples(s, h, fresh.df()))
            step = {}
            for n, parts in following.items():
                found = reduce(DataFrame.unionByName, parts).distinct()
                if n in reached:
                    found = minus(found, reached[n].df())
                if n not in state.full:
                    continue
                new = Stored.of(within(found, state.full[n].df()), "reached")
                step[n] = new
                reached[n] = reached[n].plus(new) if n in reached else new
        # What stays for sure.
        full = dict(state.full)
        for n, d in {**reached, **dead_prov}.items():
            if n in full:
                full[n] = Stored.of(minus(full[n].df(), d.df().distinct()), "kept")
        after = State(local, no, full)
        # Bring back: rows with local support, and heads of surviving firings.
        back: dict[str, DataFrame] = {}
        for n, d in reached.items():
            parts = [within(d.df().distinct(), local[n].df())]
            for s in self.splits:
                if s.provenance not in full:
                    continue
                for h in s.heads:
                    if h.relation == n:
                        derived = within(self._tuples(s, h, full[s.provenance].df()), d.df()).distinct()
                        parts.append(minus(derived, no[n].df()) if self.rejections else derived)
            back[n] = reduce(DataFrame.unionByName, parts).distinct()
        delta = {n: s for n, df in back.items() if not (s := Stored.of(df, "back")).is_empty()}
        # From here re-derivation is an insertion: firings whose body is back fire again.
        if delta:
            start = {n: s for n, s in full.items()}
            after.full, _ = propagate(self.rules, start, delta, self._fixed(after), self.shapes)
        return after

    def undo_side_effects(self, state: State, deleted: Mapping[str, DataFrame], allow: bool = False) -> dict[str, DataFrame]:
        """Source deletions that carry target deletions back through a mapping: the local rows
        behind ``deleted``; unless side effects are allowed, without those that also support
        rows which are to stay."""
        out: dict[str, DataFrame] = {}
        for name, df in deleted.items():
            full = self.system.find(name).full
            wanted = aligned(df, self.struct(full))
            for s in self.splits:
                if s.provenance not in state.full:
                    continue
                prov = state.full[s.provenance].df()
                for h in s.heads:
                    if h.relation != full:
                        continue
                    mine = self._matching(s, h, prov, wanted)
                    others = minus(prov, mine)
                    for a in s.body_atoms:
                        if any(x.deletable for x in s.body_atoms) and not a.deletable:
                            continue
                        candidates = within(self._tuples(s, a, mine).distinct(), state.local[a.relation].df())
                        free = candidates if allow else minus(candidates, self._tuples(s, a, others).distinct())
                        out[a.relation] = out[a.relation].unionByName(free).distinct() if a.relation in out else free
        return out

    # ------------------------------------------------------------ trust annotations

    def annotated(self, state: State, name: str, peer: str) -> DataFrame:
        """Rows of a relation with ``<peer>_TRUST``: the priority of a local row, and over a
        derivation the least trust of its body; of several derivations the greatest."""
        full = self.system.find(name).full
        column = f"{peer}_TRUST"
        frames = {n: Stored.of(self._base_trust(state, n, peer, column), "trust") for n in self.system.relations}
        heads = {h.relation for s in self.splits for h in s.heads}
        for _ in range(1000):
            # Trust only grows and has finitely many values, so this ends.
            current = {n: s.df() for n, s in frames.items()}
            lifted = {n: Stored.of(self._lifted(state, n, current, column), "trust") for n in heads}
            changed = [n for n in heads if not minus(lifted[n].df(), current[n]).isEmpty()]
            frames |= lifted
            if not changed:
                return frames[full].df()
        raise RuntimeError("trust did not settle in 1000 rounds")

    def _base_trust(self, state: State, full: str, peer: str, column: str) -> DataFrame:
        rows = state.local[full].df()
        own = self.system.relations[full].peer == peer
        value = F.lit(1) if own else F.lit(0)
        conditions = [t for t in self.system.trust if t.peer == peer and self.system.find(t.relation).full == full]
        for t in sorted(conditions, key=lambda t: t.priority):
            value = F.when(F.expr(t.predicate) if t.predicate else F.lit(True), F.lit(t.priority)).otherwise(value)
        return rows.withColumn(column, value.cast("int"))

    def _lifted(self, state: State, full: str, frames: Mapping[str, DataFrame], column: str) -> DataFrame:
        names = self.struct(full).names
        parts = [frames[full]]
        for s in self.splits:
            if s.provenance not in state.full or not any(h.relation == full for h in s.heads):
                continue
            rows = state.full[s.provenance].df()
            shape = rows.columns
            for k, a in enumerate(s.body_atoms):
                # Each firing meets its tuple's trust; the least so far is carried along.
                tagged = self._tagged(s, a, rows, [column] if k else [])
                other = frames[a.relation].select(*[F.col(c).alias(f"__t_{c}") for c in self.struct(a.relation).names], F.col(column).alias("__w"))
                on = reduce(lambda x, y: x & y, [tagged[f"`@{c}`"].eqNullSafe(other[f"__t_{c}"]) for c in self.struct(a.relation).names])
                level = F.least(F.col("__w"), F.col(column)) if k else F.col("__w")
                rows = tagged.join(other, on).select(*[F.col(f"`{c}`") for c in shape], level.alias(column))
            for h in s.heads:
                if h.relation == full:
                    parts.append(self._tagged(s, h, rows, [column]).select(*[F.col(f"`@{c}`").alias(c) for c in names], column))
        return reduce(DataFrame.unionByName, parts).groupBy(*names).agg(F.max(column).alias(column))
