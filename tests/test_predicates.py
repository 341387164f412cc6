from rillmesh.operators import predicates as pr
from rillmesh.operators import reconcile as rc
from rillmesh.plans import mappings as maps
from rillmesh.plans.rules import parse_rule, parse_rules

from .conftest import rows


def test_predicates_agree_with_their_sql_and_survive_xml(spark):
    df = spark.createDataFrame([(1, "ab", 1.5, 2), (2, "it's", None, 2), (3, None, 0.5, 1)], "a int, b string, c double, d int")
    cases = [
        (pr.Compare("a", ">=", 2), [2, 3]), (pr.Compare("a", "!=", "d", True), [1, 3]), (pr.Compare("b", "=", "it's"), [2]), (pr.Negated(pr.Compare("c", "<", 1.0)), [1]),
        (pr.All((pr.Compare("a", "<", 3), pr.Any((pr.Test("c", "null"), pr.Test("b", "like", ("a%",)))))), [1, 2]), (pr.Test("a", "in", (1, 3)), [1, 3]), (pr.Test("a", "between", (2, 3)), [2, 3]),
    ]
    for p, want in cases:
        assert rows(pr.selected(df, p), "a") == rows(pr.sql_filter(df, p), "a") == [(x,) for x in want]
        assert pr.from_xml(pr.to_xml(p)) == p


def test_rule_rewrites():
    r = maps.merged_firings(parse_rule("h(y, z) :- M(k, y, _), M(k, _, z), s(y)"), {"M": [0]})
    assert len(r.positive()) == 2 and r.head.args == (r.positive()[0].args[1], r.positive()[0].args[2])
    assert str(maps.inlined(parse_rule("h(x) :- v(x, 3), w(x)"), parse_rules(["v(a, b) :- r(b, a)", "w(x) :- p(x)", "w(x) :- q(x)"]))) == "h(x) :- r(3, x), w(x)"


def test_log_conversions_and_versions(spark):
    new, old = spark.createDataFrame([("n", 2)], "name string, val int"), spark.createDataFrame([("m", 1)], "name string, val int")
    log = rc.to_transactions(new, old, "p", "R", 2, ["name", "val"])
    assert log.count() == 2 and log.select("txn").distinct().count() == 2
    first = rc.to_transactions(old, new.limit(0), "p", "R", 1, ["name", "val"])
    both = first.unionByName(log)
    ins, gone = rc.to_deltas(both, "R", ["name"])
    assert rows(ins) == [("n", 2)] and rows(gone) == []
    ins, gone = rc.to_deltas(both, "R", ["name"], after=1)
    assert rows(ins) == [("n", 2)] and rows(gone) == [("m", 1)]
    got = sorted((r["key"]["name"], r["since"], r["until"]) for r in rc.versions(both, ["name"]).collect())
    assert got == [("m", 1, 2), ("n", 2, None)]
    r = rc.Reconciler(spark, "p", ["name"], [])
    r.reconcile(first)
    assert r.lookup({"name": "m"}) == [("m", 1)] and r.lookup({"name": "zz"}) == []
    assert r.reset() is None and r.lookup({"name": "m"}) == []
