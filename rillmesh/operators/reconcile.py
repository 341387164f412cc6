"""Reconciliation: peers accept, reject or defer each other's transactions by trust.

An update log has one row per update: ``txn`` (id), ``peer``, ``epoch``, ``seq`` (order within the
transaction), ``relation``, ``old`` and ``new`` (structs of the relation's columns; null old:
insertion, null new: deletion) and ``prev`` (ids of the transactions whose rows it builds on).

Work per priority level is joins and aggregates over the candidates; the loop runs over the
distinct priorities, of which a trust policy has few.  Conflicts are kept as rows
(conflict, option, transaction), so a key with many writers costs its writers, not their pairs.

Every reconciliation has a number.  Values are kept by number with the transaction that set them,
so an earlier state can be read, and a resolution replays from the first reconciliation it touches.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.catalog import TrustCondition
from ..plans.fixpoint import evaluate
from ..plans.rules import parse_rules
from ..storage import Stored

ACCEPT, REJECT, DEFER = "ACCEPT", "REJECT", "DEFER"
#: Why a transaction was not accepted.
CONFLICT, ANTECEDENT, STATE, DIRTY = "conflict", "antecedent", "state", "dirty"
_STATUS = "txn string, status string, priority int, cause string"


class InconsistentUpdates(ValueError):
    """Updates of a transaction that do not chain."""


def _key(struct: Column, keys: list[str]) -> Column:
    return F.struct(*[struct[k].alias(k) for k in keys])


def keyed(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates with their ``key``; one that changes its key becomes a deletion and an insertion."""
    old, new = _key(F.col("old"), keys), _key(F.col("new"), keys)
    moves = F.col("old").isNotNull() & F.col("new").isNotNull() & ~old.eqNullSafe(new)
    kind = updates.schema["new"].dataType
    nothing = F.lit(None).cast(kind)
    parts = F.when(moves, F.array(F.struct(old.alias("key"), F.col("old").alias("old"), nothing.alias("new"), F.lit(0).alias("half")), F.struct(new.alias("key"), nothing.alias("old"), F.col("new").alias("new"), F.lit(1).alias("half")))).otherwise(F.array(F.struct(F.when(F.col("new").isNotNull(), new).otherwise(old).alias("key"), F.col("old").alias("old"), F.col("new").alias("new"), F.lit(0).alias("half"))))
    rest = [c for c in updates.columns if c not in ("old", "new")]
    return updates.select(*rest, F.explode(parts).alias("u")).select(*rest, "u.key", "u.old", "u.new", "u.half")


def flatten(updates: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """One update per transaction and key: the first old value and the last new one.  Insert and
    delete cancel out; a chain whose old value is not what the update before it left is an
    error (``check``)."""
    rows = keyed(updates, keys)
    by = ["txn", "relation", "key"]
    if check:
        order = Window.partitionBy(*by).orderBy("seq", "half")
        odd = rows.withColumn("__left", F.lag("new").over(order)).withColumn("__n", F.row_number().over(order)).where("__n > 1").where(~F.col("__left").eqNullSafe(F.col("old")))
        if not odd.isEmpty():
            raise InconsistentUpdates(str(odd.first()["txn"]))
    at = F.struct("seq", "half")
    # Structs with the value inside, as an aggregate by order would skip a null value.
    flat = rows.groupBy(*by).agg(F.min_by(F.struct("old"), at)["old"].alias("old"), F.max_by(F.struct("new"), at)["new"].alias("new"), F.first("peer").alias("peer"), F.flatten(F.collect_set("prev")).alias("prev"))
    flat = flat.where("old is not null or new is not null").where(~F.col("old").eqNullSafe(F.col("new")))
    return _with_ends(flat, updates, keys)


def _with_ends(flat: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``flat`` with ``becomes``: what its transaction makes of the old row in the end, be it under
    another key (null: deleted, or no old row), and ``moved``: whether that is another key."""
    by = ["txn", "relation", "key"]
    plain = flat.withColumn("becomes", F.when(F.col("old").isNotNull(), F.col("new"))).withColumn("moved", F.lit(False))
    moves = updates.where("old is not null and new is not null").where(~_key(F.col("old"), keys).eqNullSafe(_key(F.col("new"), keys))).select("txn", "relation").distinct()
    if moves.isEmpty():
        return plain
    at = updates.schema["seq"].dataType
    steps = updates.where("old is not null").join(moves, ["txn", "relation"], "left_semi").select("txn", "relation", F.col("old").alias("from"), F.col("new").alias("to"), "seq")
    now = flat.where("old is not null").join(moves, ["txn", "relation"], "left_semi").select(*by, F.col("old").alias("row"), F.lit(None).cast(at).alias("at"))
    ends = []
    while not now.isEmpty():  # one round a step of the longest chain in a transaction that moves a row
        s = steps.withColumnsRenamed({"txn": "__t", "relation": "__r"})
        later = F.col("at").isNull() | (F.col("seq") > F.col("at"))
        met = now.join(s, (F.col("txn") == F.col("__t")) & (F.col("relation") == F.col("__r")) & F.col("row").eqNullSafe(F.col("from")) & later, "left")
        went = Stored.of(met.groupBy(*by).agg(F.first(F.struct("row"))["row"].alias("row"), F.min_by(F.struct("to"), "seq")["to"].alias("to"), F.min("seq").alias("at")), "ends").df()
        ends.append(went.where("at is null or to is null").select(*by, F.when(F.col("at").isNull(), F.col("row")).alias("end")))
        now = went.where("at is not null and to is not null").select(*by, F.col("to").alias("row"), "at")
    traced = reduce(DataFrame.unionByName, ends) if ends else None
    if traced is None:
        return plain
    found = plain.join(traced.withColumn("traced", F.lit(True)), by, "left").withColumn("becomes", F.when(F.col("traced"), F.col("end")).otherwise(F.col("becomes")))
    return found.withColumn("moved", F.coalesce(F.col("becomes").isNotNull() & ~_key(F.col("becomes"), keys).eqNullSafe(F.col("key")), F.lit(False))).drop("traced", "end")


def conflict_rows(flat: DataFrame) -> DataFrame:
    """Conflicts as (kind, relation, about, option, txn): KEY (one key, several new values) and
    UPDATE (one old value that some delete or move to another key and others keep, change or move
    elsewhere; updates to different new values of the same key are KEY conflicts already)."""
    about = ["kind", "relation", "about"]
    key = flat.where("new is not null").select(F.lit("KEY").alias("kind"), "relation", F.to_json("key").alias("about"), F.to_json("new").alias("option"), "txn", F.lit(False).alias("moved"))
    update = flat.where("old is not null").select(F.lit("UPDATE").alias("kind"), "relation", F.to_json("old").alias("about"), F.coalesce(F.to_json("becomes"), F.lit("")).alias("option"), "txn", "moved")
    rows = key.unionByName(update)
    # Least and greatest option say whether there are several, with partial sums before the shuffle.
    several = rows.groupBy(*about).agg(F.min("option").alias("least"), F.max("option").alias("most"), F.max("moved").alias("moves")).where("least <> most and (kind = 'KEY' or least = '' or moves)").select(*about)
    return rows.select(*about, "option", "txn").join(several, about, "left_semi").distinct()


def conflict_groups(flat: DataFrame) -> DataFrame:
    """:func:`conflict_rows` with an option's transactions in one row (``txns``); for inspection."""
    return _grouped(conflict_rows(flat))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "relation", "about", "option").agg(F.sort_array(F.collect_set("txn")).alias("txns"))


def conflict_pairs(flat: DataFrame) -> DataFrame:
    """Pairs of transactions in conflict, smaller id first; for inspection of small sets."""
    g = conflict_rows(flat)
    other = g.select("kind", "relation", "about", F.col("option").alias("o2"), F.col("txn").alias("txn2"))
    return g.join(other, ["kind", "relation", "about"]).where("option <> o2 and txn < txn2").select("kind", "txn", "txn2").distinct()


def initial_conflicts(flat: DataFrame) -> DataFrame:
    """Transactions that start from one initial version and end differently."""
    rows = flat.where("old is not null").select(F.to_json("old").alias("about"), F.concat_ws(",", F.sort_array("prev")).alias("start"), F.coalesce(F.to_json("new"), F.lit("")).alias("option"), "txn")
    options = rows.groupBy("about", "start", "option").agg(F.sort_array(F.collect_set("txn")).alias("txns"))
    several = options.groupBy("about", "start").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return options.join(several, ["about", "start"])


def priorities(flat: DataFrame, peer: str, trust: list[TrustCondition]) -> DataFrame:
    """(txn, priority) as ``peer`` sees it: own transactions highest; 0 if any update is
    untrusted; else the highest priority among its updates.  A relation without any condition
    of the peer is trusted at 1."""
    mine = [t for t in trust if t.peer == peer]
    declared = {t.relation for t in mine}
    level: Column = F.lit(0)
    for t in sorted(mine, key=lambda t: t.priority):
        test = (F.col("relation") == t.relation) & (F.col("peer") == t.origin)
        if t.predicate:
            test &= F.expr(t.predicate)
        level = F.when(test, F.lit(t.priority)).otherwise(level)
    level = F.when(F.col("peer") == peer, F.lit(TrustCondition.OWN)).when(~F.col("relation").isin(*declared) if declared else F.lit(True), F.lit(1)).otherwise(level)
    rows = flat.withColumn("__p", F.coalesce(level, F.lit(0)))
    return rows.groupBy("txn").agg(F.when(F.min("__p") == 0, F.lit(0)).otherwise(F.max("__p")).cast("int").alias("priority"))


def antecedents(updates: DataFrame) -> DataFrame:
    """(txn, needs): every transaction that one directly or indirectly builds on."""
    direct = updates.select("txn", F.explode("prev").alias("needs")).where("txn <> needs").distinct()
    rules = parse_rules(["needs(x, y) :- direct(x, y)", "needs(x, z) :- needs(x, y), direct(y, z)"])
    return evaluate(rules, {"direct": direct})["needs"].toDF("txn", "needs")


def needed_updates(flat: DataFrame, applied: DataFrame, needs: DataFrame) -> DataFrame:
    """What of ``flat`` is still to be done where ``applied`` (updates in the same form) has been.

    An update whose old row nothing has changed stays as it is.  Where an applied update started from the same
    row, one that comes before it is done already and goes, one that builds on it starts from what that one left; two
    without such an order are an error.  ``needs``: (txn, needs) as :func:`antecedents` gives it.  Insertions are held
    against applied insertions of the key."""
    done = applied.select(F.col("relation").alias("__r"), F.col("key").alias("__k"), F.col("old").alias("__old"), F.col("new").alias("__new"), F.col("txn").alias("__t"))
    met = flat.join(done, (F.col("relation") == F.col("__r")) & F.col("key").eqNullSafe(F.col("__k")) & F.col("old").eqNullSafe(F.col("__old")), "left")
    newer = needs.select(F.col("txn"), F.col("needs").alias("__t"), F.lit(True).alias("newer")).distinct()
    older = needs.select(F.col("needs").alias("txn"), F.col("txn").alias("__t"), F.lit(True).alias("older")).distinct()
    placed = met.join(newer, ["txn", "__t"], "left").join(older, ["txn", "__t"], "left")
    is_newer, is_older = F.coalesce("newer", F.lit(False)), F.coalesce("older", F.lit(False)) | (F.col("txn") == F.col("__t"))
    odd = F.raise_error(F.concat(F.lit("no order between "), "txn", F.lit(" and "), "__t"))
    keep = F.when(F.col("__t").isNull(), True).when(is_newer & ~is_older, True).when(is_older & ~is_newer, False).otherwise(odd.cast("boolean"))
    rebased = F.when(F.col("__t").isNotNull(), F.col("__new")).otherwise(F.col("old"))
    return placed.where(keep).withColumn("old", rebased).where(~F.col("old").eqNullSafe(F.col("new"))).select(*flat.columns)


def detailed(statuses: DataFrame) -> DataFrame:
    """``statuses`` with REJECTCONFLICT and DEFERCONFLICT apart from other rejections and deferrals."""
    told = F.when((F.col("cause") == CONFLICT) & F.col("status").isin(REJECT, DEFER), F.concat("status", F.lit("CONFLICT")))
    return statuses.withColumn("status", F.coalesce(told, "status"))


@dataclass
class Decisions:
    """Outcome of one reconciliation."""

    statuses: DataFrame  # txn, status, priority, cause
    state: DataFrame  # relation, key, value, txn
    dirty: DataFrame  # relation, key
    open: DataFrame  # conflicts among deferred transactions: kind, relation, about, option, txn
    unknown: DataFrame  # txn: trusted by no condition, left undecided

    @property
    def conflicts(self) -> DataFrame:
        """``open`` with an option's transactions in one row."""
        return _grouped(self.open)


class Reconciler:
    """A peer's decisions over a log, epoch by epoch."""

    def __init__(self, spark: SparkSession, peer: str, keys: list[str], trust: list[TrustCondition]):
        self.spark, self.peer, self.keys, self.trust = spark, peer, keys, trust
        self._forget()

    def _forget(self) -> None:
        self.recno = self.own = 0
        self.state: DataFrame | None = None
        self.dirty: DataFrame | None = None
        self.decided: DataFrame | None = None
        #: By reconciliation: what changed (null value: deleted), what was decided, which keys were dirty,
        #: which transactions were seen first.
        self.values: Stored | None = None
        self.history: Stored | None = None
        self.soiled: Stored | None = None
        self.seen: Stored | None = None

    def _keep(self, name: str, rows: DataFrame) -> None:
        """Adds rows of this reconciliation to one of its histories."""
        part = Stored.of(rows.withColumn("recno", F.lit(self.recno)), name)
        known = getattr(self, name)
        setattr(self, name, part if known is None else known.plus(part))

    def reconcile(self, updates: DataFrame, resolved: Mapping[str, str] | DataFrame | None = None) -> Decisions:
        """Decides all transactions of ``updates`` that are not accepted or rejected yet.
        ``resolved``: statuses that the user has chosen (or rows of txn, status)."""
        self.recno += 1
        if self.decided is not None:
            done = self.decided.where(F.col("status") != DEFER).select("txn")
            updates = updates.join(done, "txn", "left_anti")
        met = updates.select("txn").distinct()
        self._keep("seen", met if self.seen is None else met.join(self.seen.df().select("txn"), "txn", "left_anti"))
        flat = Stored.of(flatten(updates, self.keys), "flat").df()
        ranked = Stored.of(priorities(flat, self.peer, self.trust), "ranked").df()
        needs = Stored.of(antecedents(updates), "needs").df()
        # Reverse tables: who writes which option of which conflict.
        g = Stored.of(conflict_rows(flat), "options").df()
        statuses = self._known()
        if resolved is not None:
            chosen = resolved if isinstance(resolved, DataFrame) else self.spark.createDataFrame(list(resolved.items()), "txn string, status string")
            chosen = chosen.join(statuses, "txn", "left_anti").select("txn", "status", F.lit(TrustCondition.OWN).alias("priority"), F.lit(CONFLICT).alias("cause"))
            statuses = Stored.of(statuses.unionByName(chosen), "status").df()
        levels = sorted((r["priority"] for r in ranked.select("priority").distinct().collect()), reverse=True)
        for p in levels:
            if p == 0:
                continue
            new = ranked.where((F.col("priority") == p)).join(statuses.select("txn"), "txn", "left_anti").select("txn")
            decided = self._level(new, g, statuses, needs, flat)
            statuses = Stored.of(statuses.unionByName(decided.withColumn("priority", F.lit(p))), "status").df()
        return self._finish(flat, ranked, statuses, g)

    def _known(self) -> DataFrame:
        if self.decided is not None:
            return self.decided.where(F.col("status") != DEFER)
        return self.spark.createDataFrame([], _STATUS)

    def _level(self, new: DataFrame, g: DataFrame, statuses: DataFrame, needs: DataFrame, flat: DataFrame) -> DataFrame:
        """Statuses of one priority's transactions against higher ones and each other."""
        about = ["kind", "relation", "about"]
        placed = g.join(statuses.select("txn", "status"), "txn", "left")
        ours = g.join(new, "txn", "left_semi").select(*about, "option", "txn")
        # Options of a conflict by what has been decided for them, then sums by conflict: a
        # transaction's rivals are the conflict's total less its own option; no pair is listed.
        flags = [F.max((F.col("status") == ACCEPT).cast("int")).alias("acc"), F.max((F.col("status") == DEFER).cast("int")).alias("dfr")]
        options = placed.where("status is not null").groupBy(*about, "option").agg(*flags)
        totals = options.groupBy(*about).agg(F.sum("acc").alias("all_acc"), F.sum("dfr").alias("all_dfr"))
        level = ours.groupBy(*about).agg(F.count_distinct("option").alias("n"))
        # A transaction doesn't rival what it was built on, nor what was built on it.
        kin = needs.unionByName(needs.select(F.col("needs").alias("txn"), F.col("txn").alias("needs"))).distinct()
        others = placed.select(*about, F.col("option").alias("o2"), F.col("txn").alias("needs"), "status")
        related = ours.join(kin, "txn").join(others, [*about, "needs"]).where("option <> o2").groupBy(*about, "txn", "o2").agg(*flags, F.max(F.col("status").isNull().cast("int")).alias("undecided"))
        own_kin = related.groupBy(*about, "txn").agg(F.sum(F.coalesce("acc", F.lit(0))).alias("kin_acc"), F.sum(F.coalesce("dfr", F.lit(0))).alias("kin_dfr"), F.sum("undecided").alias("kin_n"))
        seen = ours.join(totals, about, "left").join(options, [*about, "option"], "left").join(level, about, "left").join(own_kin, [*about, "txn"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        against = seen.groupBy("txn").agg(*[F.max((zero(f"all_{k}") - zero(k) - zero(f"kin_{k}") > 0).cast("int")).alias(k) for k in ("acc", "dfr")], F.max((zero("n") - 1 - zero("kin_n") > 0).cast("int")).alias("tie"))
        lost = needs.join(statuses.select(F.col("txn").alias("needs"), "status"), "needs").groupBy("txn").agg(F.max((F.col("status") == REJECT).cast("int")).alias("r_needs"), F.max((F.col("status") == DEFER).cast("int")).alias("d_needs"))
        clash = self._state_conflicts(flat.join(new, "txn", "left_semi")).withColumn("clash", F.lit(1))
        soiled = self._dirty_hits(flat.join(new, "txn", "left_semi")).withColumn("soiled", F.lit(1))
        rows = reduce(lambda a, b: a.join(b, "txn", "left"), [against, lost, clash, soiled], new)
        yes = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
        status = F.when(yes("acc") | yes("r_needs") | yes("clash"), REJECT).when(yes("dfr") | yes("d_needs") | yes("tie") | yes("soiled"), DEFER).otherwise(ACCEPT)
        cause = F.when(yes("acc"), CONFLICT).when(yes("r_needs"), ANTECEDENT).when(yes("clash"), STATE).when(yes("dfr") | yes("tie"), CONFLICT).when(yes("d_needs"), ANTECEDENT).when(yes("soiled"), DIRTY)
        return rows.select("txn", status.alias("status"), cause.alias("cause"))

    def _state_conflicts(self, flat: DataFrame) -> DataFrame:
        """Transactions whose new key already has another value, or whose old value is gone."""
        if self.state is None:
            return self.spark.createDataFrame([], "txn string")
        s = self.state.select(F.col("relation").alias("__r"), F.col("key").alias("__k"), "value")
        own = flat.join(s, (F.col("relation") == F.col("__r")) & F.col("key").eqNullSafe(F.col("__k")), "left")
        bad = (F.col("old").isNull() & F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("new"))) | (F.col("old").isNotNull() & F.col("prev").isNotNull() & (F.size("prev") == 0) & ~F.col("value").eqNullSafe(F.col("old")))
        return own.where(bad).select("txn").distinct()

    def _dirty_hits(self, flat: DataFrame) -> DataFrame:
        if self.dirty is None:
            return self.spark.createDataFrame([], "txn string")
        return flat.join(self.dirty, ["relation", "key"], "left_semi").select("txn").distinct()

    def _finish(self, flat: DataFrame, ranked: DataFrame, statuses: DataFrame, g: DataFrame) -> Decisions:
        accepted = flat.join(statuses.where(F.col("status") == ACCEPT).select("txn", "priority"), "txn")
        self._apply(accepted)
        before = self._known().select("txn")
        deferred = statuses.where(F.col("status") == DEFER)
        self.dirty = Stored.of(flat.join(deferred, "txn", "left_semi").select("relation", "key").distinct(), "dirty").df()
        decided = Stored.of(statuses, "decided").df()
        self._keep("soiled", self.dirty)
        self._keep("history", decided.join(before, "txn", "left_anti"))
        self.decided = decided
        unknown = ranked.where("priority = 0").join(statuses, "txn", "left_anti").select("txn")
        open_ = g.join(deferred, "txn", "left_semi").select("kind", "relation", "about", "option", "txn")
        return Decisions(self.decided, self.state, self.dirty, open_, unknown)

    def _apply(self, accepted: DataFrame) -> None:
        """Brings the state up to newly accepted updates (with their ``priority``).

        Of several of a key the one that others build on is the older.  Those that are left agree on
        the value, or one makes what another that moves its row away leaves: a value goes before none,
        and the highest priority, then the greatest id, names the transaction."""
        later = accepted.select(F.explode("prev").alias("txn"), "relation", "key")
        last = accepted.join(later, ["txn", "relation", "key"], "left_anti")
        order = F.struct(F.col("new").isNotNull().alias("there"), "priority", "txn")
        changed = last.groupBy("relation", "key").agg(F.max_by(F.struct(F.col("new").alias("value"), "txn"), order).alias("u")).select("relation", "key", "u.value", "u.txn")
        self._keep("values", changed)
        changed = self.values.df().where(F.col("recno") == self.recno).drop("recno")
        now = changed.where("value is not null")
        if self.state is not None:
            now = self.state.join(changed.select("relation", "key"), ["relation", "key"], "left_anti").unionByName(now)
        self.state = Stored.of(now, "state").df()

    def state_at(self, recno: int) -> DataFrame:
        """(relation, key, value, txn) as after reconciliation ``recno``."""
        if self.values is None:
            raise ValueError("nothing has been reconciled")
        last = self.values.df().where(F.col("recno") <= recno).groupBy("relation", "key").agg(F.max_by(F.struct("value", "txn"), "recno").alias("u"))
        return last.where("u.value is not null").select("relation", "key", "u.value", "u.txn")

    def decisions(self, recno: int | None = None) -> DataFrame:
        """(txn, status, priority, cause, recno): all that was decided, or what one reconciliation did."""
        if self.history is None:
            return self.spark.createDataFrame([], f"{_STATUS}, recno int")
        return self.history.df() if recno is None else self.history.df().where(F.col("recno") == recno)

    def status(self, txn: str) -> str | None:
        """The present status of a transaction, none if it has not been decided."""
        row = self.decided.where(F.col("txn") == txn).select("status").first() if self.decided is not None else None
        return row["status"] if row else None

    def add(self, rows: DataFrame, epoch: int = 0) -> DataFrame:
        """Own updates (relation, seq, old, new) as one transaction of the log, with an id and the
        transactions that its old rows come from.  It is applied at once and counts as accepted,
        unless it touches a dirty key: then the next reconciliation decides."""
        self.own += 1
        txn = f"{self.peer}:{self.recno}.{self.own}"
        source = self.spark.createDataFrame([], "prev array<string>")
        if self.state is not None:
            held = self.state.select(F.col("relation").alias("__r"), F.col("value").alias("__v"), F.col("txn").alias("__t"))
            built = rows.join(held, (F.col("relation") == F.col("__r")) & F.col("old").eqNullSafe(F.col("__v")))
            source = built.agg(F.sort_array(F.collect_set("__t")).alias("prev"))
        prev = source.first()
        named = [F.lit(txn).alias("txn"), F.lit(self.peer).alias("peer"), F.lit(epoch).alias("epoch"), F.array(*[F.lit(t) for t in (prev["prev"] if prev else [])]).cast("array<string>").alias("prev")]
        log = Stored.of(rows.select("relation", "seq", "old", "new", *named), "own").df()
        flat = Stored.of(flatten(log, self.keys), "flat").df()
        if not self._dirty_hits(flat).isEmpty():
            return log
        if not self._misfits(flat).isEmpty():
            raise InconsistentUpdates(txn)
        self.recno += 1
        self._keep("seen", flat.select("txn").distinct())
        mine = flat.select("txn").distinct().select("txn", F.lit(ACCEPT).alias("status"), F.lit(TrustCondition.OWN).alias("priority"), F.lit(None).cast("string").alias("cause"))
        self._apply(flat.withColumn("priority", F.lit(TrustCondition.OWN)))
        self._keep("history", mine)
        self._keep("soiled", self.dirty if self.dirty is not None else flat.select("relation", "key").limit(0))
        self.decided = Stored.of(mine if self.decided is None else self.decided.unionByName(mine), "decided").df()
        return log

    def _misfits(self, flat: DataFrame) -> DataFrame:
        """Updates whose old row is not what the state holds for the key."""
        if self.state is None:
            return flat.where("old is not null")
        s = self.state.select(F.col("relation").alias("__r"), F.col("key").alias("__k"), "value")
        return flat.join(s, (F.col("relation") == F.col("__r")) & F.col("key").eqNullSafe(F.col("__k")), "left").where(~F.col("value").eqNullSafe(F.col("old")))

    def reset(self, updates: DataFrame | None = None) -> Decisions | None:
        """Forgets every decision; with ``updates`` the log is decided anew from the start."""
        self._forget()
        return self.reconcile(updates) if updates is not None else None

    def rewind(self, recno: int) -> None:
        """Back to what held after reconciliation ``recno`` (0: the start)."""
        if not 0 <= recno <= self.recno:
            raise ValueError(recno)
        if recno == 0:
            return self._forget()
        kept = lambda rows, name: Stored.of(rows.df().where(F.col("recno") <= recno), name)
        state = Stored.of(self.state_at(recno), "state")
        self.values, self.history, self.soiled, self.seen = (kept(getattr(self, n), n) for n in ("values", "history", "soiled", "seen"))
        self.recno, self.state = recno, state.df()
        self.dirty = self.soiled.df().where(F.col("recno") == recno).drop("recno")
        # A deferred transaction has one row a reconciliation: the last counts.
        newest = self.history.df().groupBy("txn").agg(F.max_by(F.struct("status", "priority", "cause"), "recno").alias("u"))
        self.decided = Stored.of(newest.select("txn", "u.*"), "decided").df()

    def lookup(self, key: Mapping[str, object]) -> list[tuple]:
        """The accepted value of a key (none or one row)."""
        if self.state is None:
            return []
        test = reduce(lambda a, b: a & b, [F.col(f"key.{k}").eqNullSafe(F.lit(v)) for k, v in key.items()])
        return [tuple(r["value"]) for r in self.state.where(test).collect()]

    def resolve(self, updates: DataFrame, decisions: Decisions, about: str, option: str | None) -> Decisions:
        """Settles a conflict: transactions of ``option`` are accepted, those of the others rejected (None: all
        rejected).  What was decided since the first of them was seen is decided again, reconciliation by
        reconciliation; own transactions stay accepted.  ``updates``: the whole log, own transactions among it."""
        rows = decisions.open.where(F.col("about") == about)
        chosen = F.lit(False) if option is None else F.col("option") == option
        # A transaction may be in several rows; one chosen option is enough.
        settled = Stored.of(rows.groupBy("txn").agg(F.max(chosen).alias("in")).select("txn", F.when(F.col("in"), ACCEPT).otherwise(REJECT).alias("status")), "settled").df()
        seen, last = self.seen.df(), self.recno
        first = seen.join(settled, "txn", "left_semi").agg(F.min("recno")).first()[0]
        if first is None:
            raise ValueError(f"no open conflict about {about}")
        own = self.history.df().where((F.col("priority") == TrustCondition.OWN) & (F.col("status") == ACCEPT)).select("txn", "status")
        fixed = settled.unionByName(own.join(settled, "txn", "left_anti").distinct())
        self.rewind(first - 1)
        for recno in range(first, last + 1):
            met = seen.where(F.col("recno") <= recno).select("txn")
            found = self.reconcile(updates.join(met, "txn", "left_semi"), fixed.join(met, "txn", "left_semi"))
        return found


def to_transactions(inserted: DataFrame, deleted: DataFrame, peer: str, relation: str, epoch: int, columns: list[str]) -> DataFrame:
    """Changes of a relation as a log, one transaction per row, named by the row's content."""
    row = F.struct(*columns)
    nothing = lambda df: F.lit(None).cast(df.select(row.alias("s")).schema["s"].dataType)
    name = lambda op: F.concat(F.lit(f"{peer}:{epoch}:{op}:"), F.sha2(F.to_json(row), 256))
    ins = inserted.select(name("i").alias("txn"), nothing(inserted).alias("old"), row.alias("new"))
    gone = deleted.select(name("d").alias("txn"), row.alias("old"), nothing(deleted).alias("new"))
    rest = [F.lit(peer).alias("peer"), F.lit(epoch).alias("epoch"), F.lit(1).alias("seq"), F.lit(relation).alias("relation"), F.array().cast("array<string>").alias("prev")]
    return ins.unionByName(gone).select("txn", "old", "new", *rest)


def to_deltas(updates: DataFrame, relation: str, keys: list[str], after: int = 0) -> tuple[DataFrame, DataFrame]:
    """Net (inserted, deleted) rows of a relation over the epochs after ``after``."""
    rows = updates.where((F.col("relation") == relation) & (F.col("epoch") > after))
    span = keyed(rows.withColumn("txn", F.lit("all")).withColumn("seq", F.struct("epoch", "seq")), keys)
    at = F.struct("seq", "half")
    net = span.groupBy("key").agg(F.min_by(F.struct("old"), at)["old"].alias("old"), F.max_by(F.struct("new"), at)["new"].alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    return net.where("new is not null").select("new.*"), net.where("old is not null").select("old.*")


def versions(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Every key's values with the epochs in which they held (``until`` null: still)."""
    rows = keyed(updates, keys).withColumn("at", F.struct("epoch", "seq", "half"))
    last = rows.groupBy("relation", "key", "epoch").agg(F.max_by(F.struct("new"), "at")["new"].alias("value"))
    w = Window.partitionBy("relation", "key").orderBy("epoch")
    return last.withColumn("until", F.lead("epoch").over(w)).where("value is not null").select("relation", "key", "value", F.col("epoch").alias("since"), "until")
