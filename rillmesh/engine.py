"""One peer system as a whole: publish, exchange, query, reconcile, dump and restore."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import capture
from .operators.exchange import Exchange, State
from .operators.reconcile import Decisions, Reconciler
from .plans import program, proql
from .plans.catalog import System
from .plans.compile import compile_rule
from .plans.mappings import LOCAL, REJECTED
from .plans.rules import parse_rule
from .storage import Stored


@dataclass(frozen=True)
class EngineConf:
    """Flags that change results or the way they are reached."""

    incremental: bool = True
    rejection_tables: bool = True
    #: Deletions before insertions in one exchange, or after.
    insertions_first: bool = False
    require_weak_acyclicity: bool = True


class Engine:
    """A system, its exchange state and a snapshot of every relation."""

    def __init__(self, spark: SparkSession, system: System, conf: EngineConf = EngineConf()):
        self.spark, self.system, self.conf = spark, system, conf
        self.exchange = Exchange(spark, system, conf.rejection_tables, conf.require_weak_acyclicity)
        self.state: State = self.exchange.start({})
        self._reconcilers: dict[str, Reconciler] = {}

    def load(self, local: Mapping[str, DataFrame]) -> None:
        """Takes existing rows as local contributions and runs all mappings."""
        self.state = self.exchange.recompute(self.exchange.start(local))

    def rows(self, relation: str) -> DataFrame:
        return self.exchange.rows(self.state, relation)

    def publish_and_map(self, snapshots: Mapping[str, DataFrame]) -> None:
        """Finds each relation's changes against its last state, routes them to local rows and
        rejections, and exchanges them."""
        inserted: dict[str, DataFrame] = {}
        deleted: dict[str, DataFrame] = {}
        rejected: dict[str, DataFrame] = {}
        for name, now in snapshots.items():
            full = self.system.find(name).full
            now = now.select(*self.rows(full).columns)
            ins, gone = capture.changes(now, self.rows(full))
            inserted[full] = Stored.of(ins, "ins").df()
            deleted[full] = Stored.of(gone, "del").df()
            # What a mapping derives comes back unless it is rejected; other deletions reject nothing.
            rejected[full] = self.exchange.derivable(self.state, full, deleted[full])
        self.apply(inserted, deleted, rejected)

    def apply(self, inserted: Mapping[str, DataFrame], deleted: Mapping[str, DataFrame], rejected: Mapping[str, DataFrame] | None = None) -> None:
        """Exchanges local insertions, deletions and rejections."""
        if not self.conf.incremental:
            self.state = self.exchange.recompute(self.exchange.changed(self.state, inserted, deleted, rejected))
        elif self.conf.insertions_first:
            self.state = self.exchange.delete(self.exchange.insert(self.state, inserted), deleted, rejected)
        else:
            self.state = self.exchange.insert(self.exchange.delete(self.state, deleted, rejected), inserted)

    def tables(self) -> dict[str, DataFrame]:
        """Relations, local contributions, rejections and provenance relations by name."""
        found = {full: self.rows(full) for full in self.system.relations}
        found |= {full + LOCAL: s.df() for full, s in self.state.local.items()}
        found |= {full + REJECTED: s.df() for full, s in self.state.rejected.items()}
        return found | {n: s.df() for n, s in self.state.full.items() if n.startswith("PROV.")}

    def query(self, text: str) -> DataFrame:
        """One rule, or a program of several lines."""
        tables = self.tables()
        return compile_rule(parse_rule(text), tables) if "\n" not in text.strip() else program.run(text, tables)

    def provenance(self, text: str) -> dict[str, DataFrame]:
        """A path query over the local contributions behind every relation."""
        return proql.run(text, self.system, {n: s.df() for n, s in self.state.local.items()})

    def reconciler(self, peer: str, keys: list[str]) -> Reconciler:
        """A peer's reconciler, which keeps its decisions from call to call."""
        kept = self._reconcilers.get(peer)
        if kept is None or kept.keys != keys:
            kept = self._reconcilers[peer] = Reconciler(self.spark, peer, keys, self.system.trust)
        return kept

    def reconcile(self, peer: str, keys: list[str], updates: DataFrame) -> Decisions:
        return self.reconciler(peer, keys).reconcile(updates)

    def dump(self, folder: str) -> None:
        """Local rows and rejections; everything else follows from them."""
        for kind, stored in (("local", self.state.local), ("rejected", self.state.rejected)):
            for n, s in stored.items():
                s.df().write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{kind}/{n}")

    def restore(self, folder: str) -> None:
        def read(kind: str) -> dict[str, DataFrame]:
            return {n: self.spark.read.schema(self.exchange.struct(n)).parquet(f"{folder.rstrip('/')}/{kind}/{n}") for n in self.system.relations}

        self.state = self.exchange.recompute(self.exchange.start(read("local"), read("rejected")))
