import pytest

from rillmesh.operators import capture
from rillmesh.operators import reconcile as rc
from rillmesh.plans.catalog import TrustCondition

from .conftest import rows

ROW = "struct<name:string,val:int>"
LOG = f"txn string, peer string, epoch int, seq int, relation string, old {ROW}, new {ROW}, prev array<string>"
ALL = [TrustCondition(str(a), "R", str(b), 1) for a in range(4) for b in range(4) if a != b]


def log(spark, *updates):
    """(txn, peer, old, new, prev) -> rows of a log."""
    return spark.createDataFrame([(t, p, 1, i, "R", old, new, list(prev)) for i, (t, p, old, new, prev) in enumerate(updates)], LOG)


def decide(spark, peer, *updates):
    return dict((r["txn"], r["status"]) for r in rc.Reconciler(spark, peer, ["name"], ALL).reconcile(log(spark, *updates)).statuses.collect())


def test_concurrent_inserts_reject_each_other(spark):
    both = [("a", "0", None, ("Nick", 1), ()), ("b", "1", None, ("Nick", 2), ())]
    assert decide(spark, "0", *both) == {"a": "ACCEPT", "b": "REJECT"}
    assert decide(spark, "1", *both) == {"a": "REJECT", "b": "ACCEPT"}


def test_change_of_an_accepted_row_is_accepted(spark):
    assert decide(spark, "0", ("a", "0", None, ("Nick", 1), ()), ("b", "1", ("Nick", 1), ("Nick", 3), ("a",))) == {"a": "ACCEPT", "b": "ACCEPT"}


def test_concurrent_changes_reject_each_other(spark):
    base = ("a", "2", None, ("Nick", 1), ())
    both = [("b", "0", ("Nick", 1), ("Nick", 3), ("a",)), ("c", "1", ("Nick", 1), ("Nick", 2), ("a",))]
    assert decide(spark, "0", base, *both) == {"a": "ACCEPT", "b": "ACCEPT", "c": "REJECT"}


def test_equal_trust_defers_and_resolves(spark):
    updates = log(spark, ("a", "0", None, ("Nick", 1), ()), *[(t, p, ("Nick", 1), ("Nick", v), ("a",)) for t, p, v in (("b", "1", 2), ("c", "2", 3), ("d", "3", 4))])
    r = rc.Reconciler(spark, "0", ["name"], ALL)
    d = r.reconcile(updates)
    assert {x["txn"]: x["status"] for x in d.statuses.collect()} == {"a": "ACCEPT", "b": "DEFER", "c": "DEFER", "d": "DEFER"}
    groups = d.conflicts.collect()
    assert len({g["about"] for g in groups}) == 1 and sorted(g["txns"] for g in groups) == [["b"], ["c"], ["d"]]
    assert [x["key"]["name"] for x in d.dirty.collect()] == ["Nick"]
    option = next(g["option"] for g in groups if g["txns"] == ["c"])
    after = r.resolve(updates, d, groups[0]["about"], option)
    assert {x["txn"]: x["status"] for x in after.statuses.collect()} == {"a": "ACCEPT", "b": "REJECT", "c": "ACCEPT", "d": "REJECT"}
    assert [tuple(x["value"]) for x in after.state.collect()] == [("Nick", 3)]


def test_untrusted_is_left_undecided_and_dependants_follow(spark):
    got = decide(spark, "4", ("a", "0", None, ("Nick", 1), ()))
    assert got == {"a": "ACCEPT"}  # no condition of that peer for the relation: trusted at 1
    r = rc.Reconciler(spark, "0", ["name"], [TrustCondition("0", "R", "1", 1)])
    assert r.reconcile(log(spark, ("a", "2", None, ("Nick", 1), ()))).statuses.count() == 0


def test_rejected_antecedent_rejects(spark):
    got = decide(spark, "0", ("a", "0", None, ("Nick", 1), ()), ("b", "1", None, ("Nick", 2), ()), ("c", "1", ("Nick", 2), ("Nick", 5), ("b",)))
    assert got["b"] == "REJECT" and got["c"] == "REJECT"


def test_flatten(spark):
    u = log(spark, ("t", "0", None, ("N", 1), ()), ("t", "0", ("N", 1), ("N", 2), ()), ("t", "0", None, ("M", 1), ()), ("t", "0", ("M", 1), None, ()), ("u", "0", ("K", 1), ("L", 2), ()))
    got = sorted((r["txn"], r["key"]["name"], r["old"] and tuple(r["old"]), r["new"] and tuple(r["new"])) for r in rc.flatten(u, ["name"]).collect())
    assert got == [("t", "N", None, ("N", 2)), ("u", "K", ("K", 1), None), ("u", "L", None, ("L", 2))]
    with pytest.raises(rc.InconsistentUpdates):
        rc.flatten(log(spark, ("t", "0", None, ("N", 1), ()), ("t", "0", ("N", 7), ("N", 2), ())), ["name"])


def test_conflict_kinds(spark):
    flat = rc.flatten(log(spark, ("a", "0", ("N", 1), None, ()), ("b", "1", ("N", 1), ("N", 2), ()), ("c", "1", ("N", 1), ("N", 3), ())), ["name"])
    assert rows(rc.conflict_pairs(flat)) == [("KEY", "b", "c"), ("UPDATE", "a", "b"), ("UPDATE", "a", "c"), ("UPDATE", "b", "c")]
    assert rc.initial_conflicts(flat).count() == 3


def test_moves_to_other_keys_conflict(spark):
    base = ("a", "2", None, ("Nick", 1), ())
    move = lambda t, p, *to: (t, p, ("Nick", 1), to or None, ("a",))
    assert decide(spark, "0", base, move("b", "0", "Nina", 1), move("c", "1", "Nora", 1)) == {"a": "ACCEPT", "b": "ACCEPT", "c": "REJECT"}
    assert decide(spark, "0", base, move("b", "0", "Nina", 1), move("c", "1")) == {"a": "ACCEPT", "b": "ACCEPT", "c": "REJECT"}
    assert decide(spark, "3", base, move("b", "0", "Nina", 1), move("c", "1", "Nina", 1)) == {"a": "ACCEPT", "b": "ACCEPT", "c": "ACCEPT"}
    # A chain over several keys in one transaction ends in one row.
    chain = [("b", "0", ("Nick", 1), ("Nina", 1), ("a",)), ("b", "0", ("Nina", 1), ("Nora", 2), ("a",))]
    ends = {(r["txn"], r["key"]["name"]): r["becomes"] and tuple(r["becomes"]) for r in rc.flatten(log(spark, *chain), ["name"]).collect()}
    assert ends == {("b", "Nick"): ("Nora", 2), ("b", "Nora"): None}
    assert decide(spark, "3", base, *chain, move("c", "1", "Nora", 2)) == {"a": "ACCEPT", "b": "ACCEPT", "c": "ACCEPT"}


def test_priority_bounds():
    for bad in (0, 100_001):
        with pytest.raises(ValueError):
            TrustCondition("a", "R", "b", bad)


def test_local_update_routing(spark):
    f = lambda *ids: spark.createDataFrame([(i,) for i in ids], "rid int")
    u = capture.routed(f(1, 2), f(3, 4, 5), local=f(3, 5), rejected=f(2), derivable=f(4, 5))
    assert [rows(x) for x in (u.local_ins, u.local_del, u.reject_ins, u.reject_del)] == [[(1,), (2,)], [(3,), (5,)], [(4,), (5,)], [(2,)]]
    ins, gone = capture.changes(f(1, 2), f(2, 3))
    assert rows(ins) == [(1,)] and rows(gone) == [(3,)]
    assert [rows(x) for x in capture.net(f(1, 2), f(2, 3))] == [[(1,)], [(3,)]]


def named(df):
    return {r["txn"]: r["status"] for r in df.collect()}


def values(df):
    return sorted((tuple(r["value"]), r["txn"]) for r in df.collect())


def test_causes_states_by_number_and_replay(spark):
    trust = [TrustCondition("0", "R", "1", 2), TrustCondition("0", "R", "2", 2), TrustCondition("0", "R", "3", 1)]
    r = rc.Reconciler(spark, "0", ["name"], trust)
    first = [("a", "1", None, ("Nick", 1), ()), ("z", "9", None, ("Zoe", 1), ())]
    d = r.reconcile(log(spark, *first))
    assert named(rc.detailed(d.statuses)) == {"a": "ACCEPT"} and rows(d.unknown) == [("z",)]
    second = [("b", "1", ("Nick", 1), ("Nick", 2), ("a",)), ("c", "2", ("Nick", 1), ("Nick", 3), ("a",)), ("e", "3", ("Nick", 1), ("Nick", 4), ("a",)), ("f", "3", None, ("Mark", 5), ())]
    d = r.reconcile(log(spark, *first, *second))
    assert named(rc.detailed(d.statuses)) == {"a": "ACCEPT", "b": "DEFERCONFLICT", "c": "DEFERCONFLICT", "e": "DEFERCONFLICT", "f": "ACCEPT"}
    third = [("g", "1", ("Nick", 3), ("Nick", 6), ("c",)), ("h", "1", ("Mark", 5), None, ("f",))]
    whole = log(spark, *first, *second, *third)
    d = r.reconcile(whole)
    assert r.status("g") == "DEFER" and r.status("h") == "ACCEPT" and values(r.state) == [(("Nick", 1), "a")]
    assert [values(r.state_at(n)) for n in (1, 2, 3)] == [[(("Nick", 1), "a")], [(("Mark", 5), "f"), (("Nick", 1), "a")], [(("Nick", 1), "a")]]
    assert named(r.decisions(2).where("status = 'ACCEPT'")) == {"f": "ACCEPT"}
    x = next(o for o in d.open.collect() if o["txn"] == "c" and o["kind"] == "KEY")
    after = r.resolve(whole, d, x["about"], x["option"])
    got = named(after.statuses)
    assert got["c"] == "ACCEPT" and got["b"] == got["e"] == "REJECT" and got["h"] == "ACCEPT" and r.recno == 3
    assert values(r.state_at(2)) == [(("Mark", 5), "f"), (("Nick", 3), "c")]


def test_own_transactions(spark):
    r = rc.Reconciler(spark, "0", ["name"], ALL)
    own = lambda *u: spark.createDataFrame([("R", i, a, b) for i, (a, b) in enumerate(u)], f"relation string, seq int, old {ROW}, new {ROW}")
    one = r.add(own((None, ("Nick", 1)), (("Nick", 1), ("Nick", 2))))
    two = r.add(own((("Nick", 2), ("Nick", 3))))
    assert two.first()["prev"] == [one.first()["txn"]] and r.status(two.first()["txn"]) == "ACCEPT"
    assert [v for v, _ in values(r.state)] == [("Nick", 3)] and r.lookup({"name": "Nick"}) == [("Nick", 3)]
    with pytest.raises(rc.InconsistentUpdates):
        r.add(own((("Nick", 7), ("Nick", 8))))


def test_needed_updates(spark):
    flat = lambda *u: rc.flatten(log(spark, *u), ["name"])
    needs = spark.createDataFrame([("c", "b"), ("b", "a")], "txn string, needs string")
    done = flat(("b", "0", ("N", 1), ("N", 2), ()))
    got = rc.needed_updates(flat(("b", "0", ("N", 1), ("N", 2), ()), ("a", "0", ("N", 1), ("N", 9), ()), ("c", "0", ("N", 1), ("N", 3), ()), ("x", "0", None, ("M", 1), ())), done, needs)
    assert sorted((r["txn"], r["old"] and tuple(r["old"]), tuple(r["new"])) for r in got.collect()) == [("c", ("N", 2), ("N", 3)), ("x", None, ("M", 1))]
    with pytest.raises(Exception, match="no order"):
        rc.needed_updates(flat(("q", "0", ("N", 1), ("N", 3), ())), done, needs).collect()
