import pytest

from rillmesh.console import Console
from rillmesh.engine import Engine, EngineConf
from rillmesh.operators import layouts
from rillmesh.operators.tables import PredicateRegistry, TableSet
from rillmesh.plans.catalog import Field, Relation, System
from rillmesh.plans.rules import parse_tgd

from .conftest import rows


def demo():
    s = System("demo")
    s.add(Relation("A", "s", "R", (Field("x", "INT", True, labeled=False), Field("y", "INT", labeled=False))))
    s.add(Relation("B", "s", "T", (Field("y", "INT", True, labeled=False),)))
    s.mappings = [parse_tgd("T(y) :- R(x, y)", "m")]
    return s


def test_publish_reject_reinstate_and_restore(spark, tmp_path):
    e = Engine(spark, demo())
    r = lambda *v: spark.createDataFrame(list(v), "x int, y int")
    t = lambda *v: spark.createDataFrame([(x,) for x in v], "y int")
    e.publish_and_map({"R": r((1, 5), (2, 6))})
    assert rows(e.rows("T")) == [(5,), (6,)]
    e.publish_and_map({"T": t(6, 7)})  # the derived 5 is rejected, 7 is local
    assert rows(e.rows("T")) == [(6,), (7,)]
    e.publish_and_map({"R": r((1, 5), (2, 6), (3, 5))})
    assert rows(e.rows("T")) == [(6,), (7,)]  # 5 stays rejected
    e.publish_and_map({"T": t(5, 6, 7)})
    assert rows(e.rows("T")) == [(5,), (6,), (7,)]
    assert rows(e.query("ans(x) :- R(x, y), T(y), y > 5")) == [(2,)]
    assert rows(e.provenance("[T] <- [R]")["B.s.T"])[0] == (5, "local(B.s.T_L(5)) + m(local(A.s.R_L(1,5))) + m(local(A.s.R_L(3,5)))")
    e.dump(f"file://{tmp_path}/d")
    again = Engine(spark, demo(), EngineConf(incremental=False))
    again.restore(f"file://{tmp_path}/d")
    assert rows(again.rows("T")) == rows(e.rows("T"))


def test_console(spark, tmp_path):
    (tmp_path / "a_s_r.txt").write_text("1|5\n")
    c = Console(Engine(spark, demo()))
    assert "no file for B.s.T" in c.run(f"import file://{tmp_path}")
    assert c.run("insert R(2, 6)") == "inserted" and c.run("count T") == "2"
    assert c.run("delete R(1, 5)") == "deleted" and c.run("examine T") == "y\n6"
    assert c.run("query ans(x) :- R(x, 6)") == "x\n2" and "unknown" in c.run("nope") and c.run("") == ""


def test_tables(spark):
    t = TableSet(spark, {"a": spark.createDataFrame([(1,), (2,)], "x int")})
    t.create_with_companions("b", "x int")
    assert t.insert("b", t["a"]) == 2 and t.insert("b", t["a"]) == 0 and t.compare("a", "b") == 0
    t.delete("b", t["a"].where("x = 1"))
    t.migrate("b")
    t.move("b", "c")
    assert rows(t["c"]) == [(2,)] and t["b"].count() == 0 and rows(t["b_L"]) == [(2,)] and t.compare("a", "c") == 1
    t.replace("c", t["a"], replace_all=False)
    assert dict(rows(t.counts()))["c"] == 2 and len(t.examine("c")) == 2


def test_rules_as_updates(spark):
    t = TableSet(spark, {"a": spark.createDataFrame([(1,), (2,), (3,)], "x int"), "b": spark.createDataFrame([(3,)], "x int")})
    t.apply("b(x) :- a(x), x < 2")
    assert rows(t["b"]) == [(1,), (3,)]
    t.apply("NOT_a(x) :- b(x)")
    assert rows(t["a"]) == [(2,)]


def test_predicate_joins(spark):
    reg = PredicateRegistry()
    reg.register("near", lambda a, b: (a - b).between(-1, 1))
    a, b = spark.createDataFrame([(1, 10), (2, 50)], "k int, v int"), spark.createDataFrame([(1, 11), (3, 99)], "k int, v int")
    assert rows(reg.join(a, b, "near", ["v"], ["v"], "left")) == [(1, 10, 1, 11), (2, 50, None, None)]
    assert rows(reg.join(a, b, "near", ["v"], ["v"], "full", equal=["k"])) == [(None, None, 3, 99), (1, 10, 1, 11), (2, 50, None, None)]
    with pytest.raises(ValueError):
        reg.register("near", lambda a, b: a == b)


def test_layouts(spark):
    m1, m2 = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(2, 3)], "b int, c int")
    wide = layouts.outer_union({"m1": m1, "m2": m2})
    assert rows(layouts.from_outer_union(wide, "m2", ["b", "c"])) == [(2, 3)] and wide.count() == 2
    assert len(layouts.outer_join([m1, m2, m2.withColumnRenamed("c", "d")], 2)) == 2


def test_recompute_mode_and_rejection_of_derived_rows_only(spark):
    r = lambda *v: spark.createDataFrame(list(v), "x int, y int")
    t = lambda *v: spark.createDataFrame([(x,) for x in v], "y int")
    e = Engine(spark, demo(), EngineConf(incremental=False))
    e.publish_and_map({"R": r((1, 5)), "T": t(7)})
    e.publish_and_map({"T": t()})  # 7 was local, 5 derived
    assert rows(e.rows("T")) == [] and rows(e.state.rejected["B.s.T"].df()) == [(5,)] and e.state.local["B.s.T"].df().count() == 0
    e.publish_and_map({"R": r((1, 5), (2, 7))})  # 7 was not rejected, so it may come back
    assert rows(e.rows("T")) == [(7,)]
    e.apply({"T": t(5)}, {})
    assert rows(e.rows("T")) == [(5,), (7,)] and e.state.rejected["B.s.T"].df().count() == 0


def test_console_tables_and_reconciliation(spark, tmp_path):
    c = Console(Engine(spark, demo()))
    assert c.run("insert R(2, 6)") == "inserted" and c.run("translate") == "translated" and c.run("acyclic") == "weakly acyclic"
    assert c.run("compare R R") == "0" and "PROV." in c.run("tables") and "T(y)" in c.run("rules")
    assert ":- R(" in c.run("unfold v(x) :- R(x, y); ans(x) :- v(x)")  # variables are named anew
    assert "mapping" in c.run("catalog").lower() and c.run(f"export R file://{tmp_path}/out") == "exported"
    assert c.run("clear R") == "cleared" and c.run("count T") == "0"
    kind = "struct<x:int,y:int>"
    updates = spark.createDataFrame([("a", "A", 1, "A.s.R", None, (1, 2), []), ("b", "B", 1, "A.s.R", None, (1, 3), [])], f"txn string, peer string, seq int, relation string, old {kind}, new {kind}, prev array<string>")
    updates.write.parquet(f"file://{tmp_path}/u")
    assert c.run(f"publish file://{tmp_path}/log file://{tmp_path}/u") == "epoch 1" and c.run("epoch") == "1"
    assert [x.split("\t")[:2] for x in c.run("reconcile C x").splitlines()[1:]] == [["a", "DEFERCONFLICT"], ["b", "DEFERCONFLICT"]]
    about, option = next(x.split("\t")[2:4] for x in c.run("conflicts C x").splitlines() if x.endswith("\tb"))
    assert [x.split("\t")[1] for x in c.run(f"resolve C x '{about}' '{option}'").splitlines()[1:]] == ["REJECTCONFLICT", "ACCEPT"]
    assert c.run("state C x").endswith("\tb") and c.run("dirty C x").count("\n") == 0 and c.run("reset C x") == "reset"
