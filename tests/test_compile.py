import pytest

from rillmesh.functions import builtins
from rillmesh.operators import relational
from rillmesh.plans.compile import compile_rule, minus, within
from rillmesh.plans.rules import RuleError, parse_rule

from .conftest import rows


def run(text, **tables):
    return rows(compile_rule(parse_rule(text), tables))


def test_sql_null_does_not_join(spark):
    r = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    s = spark.createDataFrame([(None, "n"), (5, "f")], "b int, c string")
    assert run("h(a, c) :- r(a, b), s(b, c)", r=r, s=s) == [(2, "f")]


def test_labeled_null_joins_with_itself_only(spark):
    r = spark.createDataFrame([(1, None, "L1"), (2, None, "L2"), (3, "v", None), (4, None, None)], "a int, b string, b_LN string")
    s = spark.createDataFrame([(None, "L1", 10), ("v", None, 30), (None, None, 40)], "b string, b_LN string, c int")
    assert run("h(a, c) :- r(a, b), s(b, c)", r=r, s=s) == [(1, 10), (3, 30)]
    assert run("h(a) :- r(a, NULL(L2))", r=r) == [(2,)]
    assert run("h(a) :- r(a, -)", r=r) == [(4,)]
    assert run("h(a) :- r(a, 'v')", r=r) == [(3,)]


def test_ordinary_side_drops_labels(spark):
    r = spark.createDataFrame([(1, None, "L1"), (3, "v", None)], "a int, b string, b_LN string")
    s = spark.createDataFrame([("v", 30), (None, 31)], "b string, c int")
    assert run("h(a, b, c) :- r(a, b), s(b, c)", r=r, s=s) == [(3, "v", 30)]


def test_negation_is_null_safe(spark):
    r = spark.createDataFrame([(1, None), (2, 5)], "a int, b int")
    s = spark.createDataFrame([(None,)], "b int")
    assert run("h(a) :- r(a, b), NOT_s(b)", r=r, s=s) == [(2,)]
    assert run("h(a) :- r(a, _), NOT s(_)", r=r, s=s) == []


def test_set_helpers_are_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, 2)], "x int, y int")
    assert minus(a, a).count() == 0 and within(a, a).count() == 2
    assert relational.difference_count(a, a.where("x = 1")) == 1


def test_functions_and_nulls(spark):
    r = spark.createDataFrame([(7, -2, None), (9, 0, 4)], "a int, b int, c int")
    assert run("h(q, l) :- r(a, b, c), ARITH.INTDIV(q, a, b), ARITH.INTLEAST3(l, a, b, c)", r=r) == [(None, 0), (-3, None)]
    assert run("h(a) :- r(a, b, _), COMPARE.INTGREATER(b, -1)", r=r) == [(9,)]
    assert run("h(n, s) :- r(a, _, _), STRING.STRCAT(s, 'x', a), STRING.STRLEN(n, s)", r=r) == [(2, "x7"), (2, "x9")]
    with pytest.raises(builtins.UnknownFunction):
        run("h(a) :- r(a, _, _), ARITH.NOPE(z, a, a)", r=r)


def test_function_output_that_is_bound_filters(spark):
    r = spark.createDataFrame([(2, 4), (3, 5)], "a int, b int")
    assert run("h(a) :- r(a, b), ARITH.INTMUL(b, a, 2)", r=r) == [(2,)]


def test_arity_and_names(spark):
    r = spark.createDataFrame([(2, 4)], "a int, b int")
    with pytest.raises(RuleError):
        run("h(a) :- r(a)", r=r)
    with pytest.raises(RuleError):
        run("h(a) :- q(a)", r=r)
    assert run("h(b, b) :- s.r(_, b)", **{"p.s.r": r}) == [(4, 4)]


def test_predicates_check_types(spark):
    r = spark.createDataFrame([(2, "x")], "a int, b string")
    with pytest.raises(relational.TypeMismatch):
        relational.compare(r, "a", "=", "2")
    with pytest.raises(relational.TypeMismatch):
        relational.compare(r, "a", "=", "b", right_is_column=True)
    assert r.where(relational.compare(r, "a", ">=", 2)).count() == 1
