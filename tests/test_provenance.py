import pytest

from rillmesh.operators import asr, provenance
from rillmesh.plans import proql
from rillmesh.plans.catalog import Field, Relation, System
from rillmesh.plans.rules import Rule, RuleError, parse_rule, parse_tgd

from .conftest import rows


@pytest.fixture(scope="module")
def views(spark):
    tables = {"r": spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "a long, b long"), "s": spark.createDataFrame([(10, 5), (11, 7)], "b long, w long")}
    d = parse_rule("v(a, w) :- r(a, b), s(b, w)")
    return tables, [Rule(d.head, d.body, "m1")], parse_rule("ans(a) :- v(a, w)")


def test_polynomial(views):
    tables, defs, q = views
    assert rows(provenance.polynomial(q, defs, tables)) == [(1, "m1(r(1,10) * s(10,5)) + m1(r(1,11) * s(11,7))"), (2, "m1(r(2,10) * s(10,5))")]


@pytest.mark.parametrize("ring,expected", [("MULTIPLICITY", {1: 24, 2: 10}), ("TRUST", {1: 14, 2: 10}), ("WEIGHT", {1: 7, 2: 7}), ("MAX", {1: 9, 2: 7}), ("MIN", {1: 7, 2: 7})])
def test_semirings(views, ring, expected):
    tables, defs, q = views
    got = provenance.evaluate(q, defs, tables, *provenance.parse_assignment(f"evaluate {ring} assigning each CASE s SET $$.w DEFAULT SET cast(2 as bigint)"))
    assert dict(rows(got)) == expected


def test_default_leaves_annihilate_and_unknown_semiring_needs_values(views):
    tables, defs, q = views
    assert dict(rows(provenance.evaluate(q, defs, tables, provenance.semiring("trust")))) == {1: 0, 2: 0}
    assert dict(rows(provenance.evaluate(q, defs, tables, provenance.semiring("MAX")))) == {1: -2 * 2147483648, 2: -2 * 2147483648}
    with pytest.raises(provenance.InvalidAssignment):
        provenance.evaluate(q, defs, tables, provenance.semiring("other"))
    with pytest.raises(provenance.InvalidAssignment):
        provenance.parse_assignment("EVALUATE TRUST ASSIGNING EACH nonsense")


@pytest.fixture(scope="module")
def peers(spark):
    s = System("x")
    f = lambda n: Field(n, "INT", labeled=False)
    s.add(Relation("P", "s", "A", (f("x"), f("y"))))
    s.add(Relation("P", "s", "B", (f("y"), f("z"))))
    s.add(Relation("Q", "s", "C", (f("x"), f("z"))))
    s.mappings = [parse_tgd("C(x, z) :- A(x, y), B(y, z)", "M1"), parse_tgd("B(y, x) :- A(x, y)", "M2")]
    local = {"A": spark.createDataFrame([(1, 2)], "x int, y int"), "B": spark.createDataFrame([(2, 9)], "y int, z int"), "C": spark.createDataFrame([(7, 7)], "x int, z int")}
    return s, local


def test_path_query(peers):
    s, local = peers
    one = proql.run("[C $x] <- [A]", s, local)["Q.s.C"]
    assert [r[:2] for r in rows(one)] == [(1, 9), (7, 7)]
    chain = proql.run("[C] *- [A] EVALUATE MULTIPLICITY ASSIGNING EACH DEFAULT SET cast(1 as bigint)", s, local)["Q.s.C"]
    assert rows(chain) == [(1, 1, 1), (1, 9, 1), (7, 7, 1)]
    assert set(proql.run("[] <M2 - []", s, local)) == {"P.s.B"}
    assert proql.run("[A] <- []", s, local) == {}


def test_pattern_parser():
    p, clause = proql.parse("[A $x][B] <M4 - [] *- [C]")
    assert p.nodes[0].names == ("A", "B") and p.steps[0].mapping == "M4" and p.steps[1].chain and clause is None
    with pytest.raises(RuleError):
        proql.parse("[A] <- [B] junk")


def test_access_support_relations(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "x int, y int")
    b = spark.createDataFrame([(1, 5), (3, 6)], "y int, z int")
    assert rows(asr.inner([a, b]), "x", "y", "z") == [(1, 1, 5)]
    assert rows(asr.real([a, b], "full"), "x", "y", "z") == [(None, 3, 6), (1, 1, 5), (2, 2, None)]
    assert rows(asr.simulated([a, b], "full"), "x", "y", "z") == [(1, 1, 5)]
    assert asr.rewrite(["M1", "M2", "M3"], {"J": ["M1", "M2"]}) == ["J", "M3"]
