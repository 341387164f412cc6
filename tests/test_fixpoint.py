import pytest

from rillmesh.plans import program
from rillmesh.plans.fixpoint import components, evaluate
from rillmesh.plans.rules import RuleError, parse_rules
from rillmesh.plans.unfold import RecursionRefused, is_recursive

from .conftest import rows


def closure(edges):
    found = set(edges)
    while True:
        new = found | {(a, d) for a, b in found for c, d in found if b == c}
        if new == found:
            return sorted(found)
        found = new


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)]


def test_closure_linear_and_nonlinear_on_a_cycle(spark):
    e = spark.createDataFrame(EDGES, "a long, b long")
    for step in ("tc(x, z) :- tc(x, y), e(y, z)", "tc(x, z) :- tc(x, y), tc(y, z)"):
        assert rows(evaluate(parse_rules(["tc(x, y) :- e(x, y)", step]), {"e": e})["tc"]) == closure(EDGES)


def test_mutual_recursion_and_negation_above(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    zero = spark.createDataFrame([(0,)], "a long")
    out = evaluate(parse_rules(["even(x) :- zero(x)", "even(y) :- odd(x), e(x, y)", "odd(y) :- even(x), e(x, y)", "last(y) :- e(_, y), NOT_even(y)"]), {"e": e, "zero": zero})
    assert rows(out["even"]) == [(0,), (2,)] and rows(out["odd"]) == [(1,), (3,)] and rows(out["last"]) == [(1,), (3,)]


def test_head_that_is_a_table_keeps_its_rows(spark):
    e = spark.createDataFrame([(1, 2)], "a long, b long")
    t = spark.createDataFrame([(9, 9)], "a long, b long")
    assert rows(evaluate(parse_rules(["t(x, y) :- e(x, y)"]), {"e": e, "t": t})["t"]) == [(1, 2), (9, 9)]


def test_not_stratified_is_refused():
    with pytest.raises(RuleError):
        components(parse_rules(["p(x) :- r(x), NOT_q(x)", "q(x) :- p(x)", "p(x) :- q(x)"]))


def test_empty_input(spark):
    e = spark.createDataFrame([], "a long, b long")
    assert evaluate(parse_rules(["tc(x, y) :- e(x, y)", "tc(x, z) :- tc(x, y), e(y, z)"]), {"e": e})["tc"].count() == 0


def test_program_text(spark):
    e = spark.createDataFrame(EDGES, "a long, b long")
    text = """-- reachability
    tc(x, y) :- e(x, y)
    tc(x, z) :- tc(x, y), e(y, z).
    ans(y) :- tc(1, y)"""
    assert [p.recursive for p in program.parse(text)] == [True, False]
    assert rows(program.run(text, {"e": e})) == [(1,), (2,), (3,), (4,)]


def test_unfolding_refuses_recursion(spark):
    rules = parse_rules(["tc(x, y) :- e(x, y)", "tc(x, z) :- tc(x, y), e(y, z)"])
    assert is_recursive(rules, "tc") and not is_recursive(rules, "e")
    with pytest.raises(RecursionRefused):
        program.run_unfolded("tc(x, y) :- e(x, y)\ntc(x, z) :- tc(x, y), e(y, z)\nans(x) :- tc(x, _)", {"e": spark.createDataFrame([], "a long, b long")})


def test_large_accumulators_take_the_semi_join_way(spark, monkeypatch):
    from rillmesh.plans import fixpoint

    monkeypatch.setattr(fixpoint, "LARGE_BYTES", 0)
    monkeypatch.setattr(fixpoint, "LARGE_RATIO", 0)
    e = spark.createDataFrame(EDGES, "a long, b long")
    assert rows(evaluate(parse_rules(["tc(x, y) :- e(x, y)", "tc(x, z) :- tc(x, y), tc(y, z)"]), {"e": e})["tc"]) == closure(EDGES)


PARENTS = [(1, 10), (2, 10), (3, 11), (3, 10), (4, 12), (4, 12), (5, None), (None, 10), (10, 20), (11, 20), (12, 21), (20, 30), (21, 30), (6, 30), (30, 30)]
GENERATIONS = ["sg(x, y) :- p(x, q), p(y, q)", "sg(x, y) :- p(x, a), sg(a, b), p(y, b)"]


def test_lean_evaluation_gives_the_same_rows_and_stores_less(spark, monkeypatch):
    from rillmesh.plans import fixpoint

    p = spark.createDataFrame(PARENTS + [(100 + i, 12) for i in range(40)], "c long, q long")
    want = rows(evaluate(parse_rules(GENERATIONS), {"p": p})["sg"])
    stored, of = [], fixpoint.Stored.of
    monkeypatch.setattr(fixpoint.Stored, "of", lambda df, tag="rel": stored.append(of(df, tag)) or stored[-1])
    got = rows(evaluate(parse_rules(GENERATIONS), {"p": p}, lean=True)["sg"])
    assert got == want and len(want) > 1600 and len(set(got)) == len(got)
    assert sum(s.df().count() for s in stored) < len(want) / 2


def test_lean_evaluation_of_other_programs(spark):
    e = spark.createDataFrame(EDGES, "a long, b long")
    for step in ("tc(x, z) :- tc(x, y), e(y, z)", "tc(x, z) :- tc(x, y), tc(y, z)", "tc(x, z) :- e(x, y), tc(y, z), NOT_e(z, x)", "tc(z, x) :- tc(x, y), e(y, z), x < 3"):
        rules = parse_rules(["tc(x, y) :- e(x, y)", step])
        assert rows(evaluate(rules, {"e": e}, lean=True)["tc"]) == rows(evaluate(rules, {"e": e})["tc"])
    p = spark.createDataFrame(PARENTS, "c long, q long")
    for step in ("sg(x, y) :- p(x, a), sg(a, _), p(y, b), b > 20", "sg(x, y) :- p(x, a), sg(a, b), p(y, b), NOT_p(y, 20), x < 9", "sg(x, y) :- sg(x, a), sg(b, b), p(y, b), p(b, a)"):
        rules = parse_rules([GENERATIONS[0], step])
        assert rows(evaluate(rules, {"p": p}, lean=True)["sg"]) == rows(evaluate(rules, {"p": p})["sg"])


def test_same_generation_stores_no_result(spark, monkeypatch):
    from rillmesh import queries
    from rillmesh.plans import fixpoint

    stored, of = [], fixpoint.Stored.of
    monkeypatch.setattr(fixpoint.Stored, "of", lambda df, tag="rel": stored.append(of(df, tag)) or stored[-1])
    found = queries.QUERIES["fixpoint_same_generation"](spark, "/root/testdata/sf0.01").count()
    assert sum(s.df().count() for s in stored) < found
