import random

import pytest

from rillmesh.operators.exchange import Exchange
from rillmesh.plans import mappings as maps
from rillmesh.plans.catalog import Field, Relation, System, TrustCondition
from rillmesh.plans.rules import RuleError, parse_rule, parse_tgd

from .conftest import rows


def system(relations, mappings, labeled=True):
    s = System("t")
    for name, columns in relations.items():
        s.add(Relation("P", "s", name, tuple(Field(c, "INT", labeled=labeled) for c in columns.split())))
    s.mappings = [parse_tgd(text, name) for name, text in mappings.items()]
    return s


def table(spark, columns, data):
    return spark.createDataFrame(data, ", ".join(f"{c} int" for c in columns.split()))


def same(x, a, b):
    return all(rows(x.rows(a, n)) == rows(x.rows(b, n)) for n in x.system.relations)


@pytest.fixture(scope="module")
def running(spark):
    s = system({"G": "id can nam", "U": "nam can", "B": "id nam"}, {"m1": "B(i, n) :- G(i, c, n)", "m2": "U(n, c) :- G(i, c, n)", "m3": "U(n, c) :- B(i, n)", "m4": "B(i, n) :- B(i, c), U(n, c)"})
    local = {"G": table(spark, "id can nam", [(1, 2, 3), (3, 5, 2)]), "B": table(spark, "id nam", [(3, 5)]), "U": table(spark, "nam can", [(2, 5)])}
    x = Exchange(spark, s)
    return x, local, x.recompute(x.start(local))


def test_running_example(running):
    x, _, state = running
    assert rows(x.rows(state, "B")) == [(1, 3), (3, 2), (3, 3), (3, 5)]
    u = x.rows(state, "U").collect()
    assert sorted((r["nam"], r["can"]) for r in u if r["can_LN"] is None) == [(2, 5), (3, 2)]
    assert sorted(r["nam"] for r in u if r["can_LN"] is not None) == [2, 3, 5]
    assert len({r["can_LN"] for r in u if r["can_LN"]}) == 3


def test_insert_and_delete_match_recompute(running):
    x, local, state = running
    without = x.recompute(x.start({**local, "G": local["G"].where("id = 1")}))
    assert same(x, x.insert(without, {"G": local["G"].where("id = 3")}), state)
    assert same(x, x.delete(state, {"G": local["G"].where("id = 3")}), without)


def test_support_in_a_cycle_dies(spark):
    s = system({"A": "x", "B": "x", "C": "x"}, {"ab": "A(x) :- B(x)", "ba": "B(x) :- A(x)", "ca": "A(x) :- C(x)"}, labeled=False)
    x = Exchange(spark, s)
    state = x.recompute(x.start({"C": table(spark, "x", [(1,), (2,)]), "B": table(spark, "x", [(2,)])}))
    after = x.delete(state, {"C": table(spark, "x", [(1,), (2,)])})
    assert rows(x.rows(after, "A")) == [(2,)] and rows(x.rows(after, "B")) == [(2,)]


def test_rejection_blocks_and_reinsertion_lifts(spark):
    s = system({"A": "x", "B": "x", "D": "x"}, {"m": "B(x) :- A(x)", "n": "D(x) :- B(x)"}, labeled=False)
    x = Exchange(spark, s)
    state = x.recompute(x.start({"A": table(spark, "x", [(1,), (2,)])}))
    state = x.delete(state, {}, {"B": table(spark, "x", [(1,)])})
    assert rows(x.rows(state, "B")) == [(2,)] and rows(x.rows(state, "D")) == [(2,)]
    state = x.insert(state, {"B": table(spark, "x", [(1,)])})
    assert rows(x.rows(state, "D")) == [(1,), (2,)] and state.rejected["P.s.B"].df().count() == 0


def test_random_updates_match_recompute(spark):
    s = system({"A": "x y", "B": "x y", "C": "x y"}, {"m1": "B(x, y) :- A(x, y)", "m2": "C(x, z) :- B(x, y), A(y, z)", "m3": "B(y, x) :- C(x, y)"}, labeled=False)
    x = Exchange(spark, s)
    rng = random.Random(5)
    rows_a = {(rng.randrange(4), rng.randrange(4)) for _ in range(7)}
    state = x.recompute(x.start({"A": table(spark, "x y", sorted(rows_a))}))
    gone = set(rng.sample(sorted(rows_a), 3))
    state = x.delete(state, {"A": table(spark, "x y", sorted(gone))})
    new = {(3, 0), (1, 1)}
    state = x.insert(state, {"A": table(spark, "x y", sorted(new))})
    assert same(x, state, x.recompute(x.start({"A": table(spark, "x y", sorted((rows_a - gone) | new))})))


def test_weak_acyclicity():
    assert not maps.weakly_acyclic([parse_tgd("A(y, z) :- A(x, y)", "m")])
    assert maps.weakly_acyclic([parse_tgd("B(x, z) :- A(x, y)", "m"), parse_tgd("A(x, x) :- B(x, y)", "n")])
    with pytest.raises(RuleError):
        Exchange(None, system({"A": "x y"}, {"m": "A(y, z) :- A(x, y)"}))


def test_composition_of_virtual_relations(spark):
    s = system({"A": "x", "V": "x y", "B": "x y"}, {"v": "V(x, y) :- A(x), A(y), x < y", "b": "B(x, y) :- V(x, y)"}, labeled=False)
    s.virtual = {"V"}
    x = Exchange(spark, s)
    assert rows(x.rows(x.recompute(x.start({"A": table(spark, "x", [(1,), (2,), (3,)])})), "B")) == [(1, 2), (1, 3), (2, 3)]


def test_trust_annotation_is_best_of_worst(spark):
    s = system({"A": "x", "B": "x", "C": "x"}, {"m": "C(x) :- A(x), B(x)", "n": "C(x) :- B(x)"}, labeled=False)
    s.trust = [TrustCondition("Q", "A", "P", 5), TrustCondition("Q", "B", "P", 3, "x > 1"), TrustCondition("Q", "B", "P", 2)]
    x = Exchange(spark, s)
    state = x.recompute(x.start({"A": table(spark, "x", [(1,)]), "B": table(spark, "x", [(1,), (2,)])}))
    assert rows(x.annotated(state, "C", "Q")) == [(1, 2), (2, 3)]


def test_side_effect_free_deletion(spark):
    s = system({"A": "x y", "B": "x"}, {"m": "B(x) :- A(x, y)"}, labeled=False)
    x = Exchange(spark, s)
    state = x.recompute(x.start({"A": table(spark, "x y", [(1, 1), (1, 2), (2, 1)])}))
    got = x.undo_side_effects(state, {"B": table(spark, "x", [(1,)])})
    assert rows(got["P.s.A"]) == [(1, 1), (1, 2)]


def test_homomorphism_and_equalities():
    assert maps.homomorphic(parse_rule("h(x) :- r(x, y)"), parse_rule("h(a) :- r(a, 3), s(a)"))
    assert not maps.homomorphic(parse_rule("h(x) :- r(x, x)"), parse_rule("h(a) :- r(a, b)"))
    assert str(maps.without_equalities(parse_rule("h(x) :- r(x, y), y = 3"))) == "h(x) :- r(x, 3)"
