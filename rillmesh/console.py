"""A line console over an engine: ``python -m rillmesh.console catalog.xml [data folder]``."""

from __future__ import annotations

import shlex
import sys
from collections.abc import Callable

from .engine import Engine
from .operators import relational
from .operators.reconcile import Decisions, detailed, to_deltas
from .plans.mappings import qualified, weakly_acyclic
from .plans.rules import parse_rule
from .plans.unfold import distinct_rules, unfold
from .sources import catalog_xml, delimited
from .streaming.epochs import EpochLog


class Console:
    """Commands by name; each takes the rest of its line and returns text."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.log: EpochLog | None = None
        #: The last decisions by peer.
        self.last: dict[str, Decisions] = {}
        self.commands: dict[str, Callable[[str], str]] = {
            "help": self.help, "peers": lambda a: "\n".join(engine.system.peers()), "relations": lambda a: "\n".join(sorted(engine.system.relations)),
            "mappings": lambda a: "\n".join(f"{m.name}: {', '.join(map(str, m.heads))} :- {', '.join(map(str, m.body))}" for m in engine.system.mappings),
            "rules": lambda a: "\n".join(map(str, engine.exchange.rules)), "examine": self.examine, "count": self.count, "query": self.query, "run": self.run_file,
            "insert": self.insert, "delete": self.delete, "prov": self.prov, "import": self.load, "dump": self.dump, "restore": self.restore, "trust": self.trust,
            "translate": self.translate, "export": self.export, "catalog": lambda a: catalog_xml.dumps(engine.system), "acyclic": self.acyclic, "unfold": self.unfold, "tables": self.tables, "compare": self.compare, "clear": self.clear,
            "publish": self.publish, "epoch": self.epoch, "fetch": self.fetch, "reconcile": self.reconcile, "decisions": self.decisions, "conflicts": self.conflicts, "dirty": self.dirty, "state": self.reconciled, "resolve": self.resolve, "reset": self.reset,
        }

    def run(self, line: str) -> str:
        name, _, rest = line.strip().partition(" ")
        if not name:
            return ""
        if name not in self.commands:
            return f"unknown command {name}; try help"
        return self.commands[name](rest.strip())

    def help(self, _: str) -> str:
        return "commands: " + " ".join(sorted(self.commands))

    def _show(self, df, n: int = 50) -> str:
        rows = df.limit(n).collect()
        return "\n".join(["\t".join(df.columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows)])

    def examine(self, name: str) -> str:
        return self._show(self.engine.rows(name))

    def count(self, name: str) -> str:
        return str(self.engine.rows(name).count())

    def query(self, text: str) -> str:
        return self._show(self.engine.query(text))

    def run_file(self, path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return self._show(self.engine.query(f.read()))

    def _fact(self, text: str):
        """A ground atom as a one-row table of its relation."""
        atom = parse_rule(text).head
        relation = self.engine.system.find(atom.relation)
        values = tuple(getattr(t, "value", None) for t in atom.args)
        from .plans.catalog import spark_type

        schema = ", ".join(f"`{f.name}` {spark_type(f.type).simpleString()}" for f in relation.fields)
        return relation.full, self.engine.spark.createDataFrame([values], schema)

    def insert(self, text: str) -> str:
        name, row = self._fact(text)
        self.engine.apply({name: row}, {})
        return "inserted"

    def delete(self, text: str) -> str:
        name, row = self._fact(text)
        self.engine.apply({}, {name: row}, {name: self.engine.exchange.derivable(self.engine.state, name, row)})
        return "deleted"

    def prov(self, text: str) -> str:
        return "\n".join(f"{root}\n{self._show(df)}" for root, df in self.engine.provenance(text).items())

    def load(self, folder: str) -> str:
        found, failed = delimited.import_all(self.engine.spark, folder, self.engine.system)
        self.engine.load(found)
        return f"loaded {len(found)}" + (f", no file for {', '.join(failed)}" if failed else "")

    def dump(self, folder: str) -> str:
        self.engine.dump(folder)
        return "dumped"

    def restore(self, folder: str) -> str:
        self.engine.restore(folder)
        return "restored"

    def trust(self, text: str) -> str:
        relation, peer = shlex.split(text)
        return self._show(self.engine.exchange.annotated(self.engine.state, relation, peer))

    # ------------------------------------------------------------ mappings and tables

    def translate(self, _: str) -> str:
        """Runs all mappings anew from the local rows."""
        self.engine.state = self.engine.exchange.recompute(self.engine.state)
        return "translated"

    def export(self, text: str) -> str:
        """``relation folder``: a relation's rows as a delimited file."""
        name, folder = shlex.split(text)
        delimited.write(self.engine.rows(name), folder, self.engine.system.find(name))
        return "exported"

    def acyclic(self, _: str) -> str:
        return "weakly acyclic" if weakly_acyclic([qualified(self.engine.system, m) for m in self.engine.system.mappings]) else "not weakly acyclic"

    def unfold(self, text: str) -> str:
        """``rule; rule; ...``: the last rule with the others put into it."""
        *definitions, query = [parse_rule(r) for r in text.split(";") if r.strip()]
        return "\n".join(str(r) for r, _ in distinct_rules(unfold(query, definitions)))

    def tables(self, _: str) -> str:
        return self._show(relational.counts(self.engine.tables()), 1000)

    def compare(self, text: str) -> str:
        """``a b``: how many rows only one of two tables has."""
        known = self.engine.tables()
        a, b = (known[n] if n in known else self.engine.rows(n) for n in shlex.split(text))
        return str(relational.difference_count(a, b))

    def clear(self, name: str) -> str:
        """Deletes a relation's local rows."""
        full = self.engine.system.find(name).full
        self.engine.apply({}, {full: self.engine.state.local[full].df()})
        return "cleared"

    # ------------------------------------------------------------ published updates

    def _log(self) -> EpochLog:
        if self.log is None:
            raise ValueError("no log is open; publish names its folder")
        return self.log

    def publish(self, text: str) -> str:
        """``folder file``: appends a Parquet file or folder of updates to the log in ``folder``; without a file the log is opened."""
        folder, *files = shlex.split(text)
        self.log = EpochLog(self.engine.spark, folder)
        for f in files:
            self.log.publish(self.engine.spark.read.parquet(f))
        return f"epoch {self.log.last()}"

    def epoch(self, _: str) -> str:
        return str(self._log().last())

    def fetch(self, text: str) -> str:
        """``relation key,key after``: applies the net changes of a relation since an epoch."""
        name, keys, after = shlex.split(text)
        relation = self.engine.system.find(name)
        inserted, deleted = to_deltas(self._log().read(), relation.full, keys.split(","), int(after))
        self.engine.apply({relation.full: inserted}, {relation.full: deleted})
        return "fetched"

    def _mine(self, text: str):
        peer, keys = shlex.split(text)[:2]
        return peer, self.engine.reconciler(peer, keys.split(","))

    def reconcile(self, text: str) -> str:
        """``peer key,key``: decides what the log holds."""
        peer, r = self._mine(text)
        self.last[peer] = r.reconcile(self._log().read())
        return self.decisions(text)

    def decisions(self, text: str) -> str:
        peer, _ = self._mine(text)
        return self._show(detailed(self.last[peer].statuses).select("txn", "status", "priority").orderBy("txn"))

    def conflicts(self, text: str) -> str:
        peer, _ = self._mine(text)
        return self._show(self.last[peer].open.orderBy("kind", "relation", "about", "option", "txn"))

    def dirty(self, text: str) -> str:
        peer, _ = self._mine(text)
        return self._show(self.last[peer].dirty)

    def reconciled(self, text: str) -> str:
        """``peer key,key [number]``: the values accepted, as after that reconciliation."""
        _, r = self._mine(text)
        number = shlex.split(text)[2:]
        return self._show(r.state_at(int(number[0]) if number else r.recno).select("relation", "value", "txn").orderBy("relation", "txn"))

    def resolve(self, text: str) -> str:
        """``peer key,key about option``: settles a conflict for an option as :meth:`conflicts` prints them; without an option all are rejected."""
        peer, r = self._mine(text)
        about, *option = shlex.split(text)[2:]
        self.last[peer] = r.resolve(self._log().read(), self.last[peer], about, option[0] if option else None)
        return self.decisions(text)

    def reset(self, text: str) -> str:
        """``peer key,key``: forgets the peer's decisions."""
        peer, r = self._mine(text)
        r.reset()
        self.last.pop(peer, None)
        return "reset"


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    with open(args[0], encoding="utf-8") as f:
        system = catalog_xml.loads(f.read())
    console = Console(Engine(SparkSession.builder.getOrCreate(), system))
    if args[1:]:
        print(console.run(f"import {args[1]}"))
    for line in sys.stdin:
        print(console.run(line), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
