"""Laws of the tag algebras, and probabilities against all possible worlds."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.operators import tags
from ruleweave.program import Program

SCALARS = [tags.Boolean(), tags.Natural(), tags.Tropical(), tags.MinMaxProb(), tags.MaxMultProb(), tags.AddMultProb(), tags.NandMultProb()]


def values(a):
    if isinstance(a, tags.Boolean):
        return st.booleans()
    if isinstance(a, (tags.Natural, tags.Tropical)):
        return st.integers(0, 50)
    return st.floats(0, 1)


@pytest.mark.parametrize("a", SCALARS, ids=lambda a: a.name)
def test_laws(a):
    close = lambda x, y: x == y or math.isclose(x, y, abs_tol=1e-9)

    @settings(max_examples=60, deadline=None)
    @given(values(a), values(a), values(a))
    def check(x, y, z):
        assert close(a.py_plus(x, y), a.py_plus(y, x)) and close(a.py_times(x, y), a.py_times(y, x))
        assert close(a.py_plus(a.py_plus(x, y), z), a.py_plus(x, a.py_plus(y, z)))
        assert close(a.py_times(a.py_times(x, y), z), a.py_times(x, a.py_times(y, z)))
        assert close(a.py_times(a.py_one(), x), x) and close(a.py_plus(a.py_zero(), x), x)

    check()


def brute(clauses):
    facts = {x[0]: x for c in clauses for x in c}
    groups = {}
    for f, x in facts.items():
        groups.setdefault(x[2] if x[2] is not None else ("own", f), []).append(f)
    total = 0.0
    choices = [[(None, 1 - sum(facts[f][1] for f in g)), *[(f, facts[f][1]) for f in g]] for g in groups.values()]
    for world in itertools.product(*choices):
        true = {f for f, _ in world}
        if any(all((x[0] in true) != x[3] for x in c) for c in clauses):
            total += math.prod(p for _, p in world)
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=1, max_size=3), min_size=1, max_size=4))
def test_model_counts(clauses):
    probs = [0.1, 0.2, 0.3, 0.4, 0.25, 0.35]
    group = [None, None, 1, 1, None, 2]
    made = {tuple(sorted({(f, probs[f], group[f], neg) for f, neg in c}, key=str)) for c in clauses}
    made = {c for c in made if len({x[0] for x in c}) == len(c)}
    assert math.isclose(tags.wmc(made), brute(made), abs_tol=1e-9)


def test_all_proofs_are_possible_worlds(spark):
    probs = {(0, 1): 0.5, (1, 2): 0.6, (0, 2): 0.3, (2, 3): 0.7, (1, 3): 0.2}
    facts = ", ".join(f"{p}::({a}, {b})" for (a, b), p in probs.items())
    p = Program(spark, "topkproofs", k=50).add(f"rel e = {{{facts}}}\nrel r(y) = e(0, y) or (r(x) and e(x, y))")
    got = {r["c0"]: r["tag"] for r in p.relation("r").collect()}
    want = dict.fromkeys((1, 2, 3), 0.0)
    for world in itertools.product([False, True], repeat=len(probs)):
        there = [e for e, w in zip(probs, world, strict=True) if w]
        weight = math.prod(probs[e] if w else 1 - probs[e] for e, w in zip(probs, world, strict=True))
        reached, more = {0}, True
        while more:
            new = {b for a, b in there if a in reached} - reached
            reached, more = reached | new, bool(new)
        for x in reached - {0}:
            want[x] += weight
    assert all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)


def test_negation_of_many_clauses_loses_nothing(spark):
    """The negation of a formula of k proofs is exact, and so is what is not in either of two."""
    text = "rel a = {0.1::1, 0.2::2, 0.3::3}\nrel b = {0.4::1, 0.5::2}\nrel some() = a(x)\nrel more() = b(x)\nrel go = {1}\nrel out() = go(_), not some(), not more()"
    got = Program(spark, "topbottomkclauses", k=3).add(text).relation("out").collect()[0]["tag"]
    assert math.isclose(got, 0.9 * 0.8 * 0.7 * 0.6 * 0.5, abs_tol=1e-6)
    p = Program(spark, "difftopbottomkclauses", k=3).add(text).relation("out").collect()[0]["tag"]
    assert math.isclose(p["p"], got, abs_tol=1e-6) and all(math.isclose(d, -got / (1 - q), abs_tol=1e-6) for d, q in zip(sorted(p["gradient"].values(), reverse=True), (0.1, 0.2, 0.3, 0.4, 0.5), strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.booleans()), min_size=1, max_size=3), min_size=1, max_size=3), st.lists(st.lists(st.tuples(st.integers(0, 4), st.booleans()), min_size=1, max_size=3), min_size=1, max_size=3))
def test_top_bottom_operations(one, two):
    """With a large k, all operations are exact."""
    probs = [0.1, 0.2, 0.3, 0.4, 0.25]
    a = tags.TopBottomClauses(50)
    made = []
    for clauses in (one, two):
        proofs = {tuple(sorted({(f, probs[f], None, neg) for f, neg in c}, key=str)) for c in clauses}
        made.append((False, [list(c) for c in proofs if len({x[0] for x in c}) == len(c)]))
    x, y = made
    both, either = a.py_weight(a.py_times(x, y)), a.py_weight(a.py_plus(x, y))
    assert math.isclose(both + either, a.py_weight(x) + a.py_weight(y), abs_tol=1e-9)
    assert math.isclose(a.py_weight(a.py_negate(x)), 1 - a.py_weight(x), abs_tol=1e-9)
    assert math.isclose(a.py_weight(a.py_times(a.py_negate(x), a.py_negate(y))), 1 - either, abs_tol=1e-9)
    assert math.isclose(a.py_weight(a.py_plus(a.py_negate(x), y)), 1 - a.py_weight(x) + both, abs_tol=1e-9)


def test_dual_numbers_are_derivatives(spark):
    """Gradients against differences, for each scalar algebra."""
    text = "rel a = {{{p}::1, 0.3::2}}\nrel b = {{0.5::1, 0.6::2}}\nrel out() = a(x), b(x)\nrel rest() = a(1), not b(1)"
    for name in ("diffminmaxprob", "diffmaxmultprob", "diffaddmultprob", "diffnandmultprob", "diffnandminprob"):
        for relation in ("out", "rest"):
            value = lambda p: Program(spark, name).add(text.format(p=p)).relation(relation).collect()[0]["tag"]  # noqa: B023, E731
            low, mid, high = value(0.4), value(0.41), value(0.42)
            slope = (high["p"] - low["p"]) / 0.02
            assert math.isclose(slope, 0.0, abs_tol=1e-6) or any(math.isclose(slope, d, abs_tol=1e-5) for d in mid["gradient"].values())


def test_gradients(spark):
    p = Program(spark, "difftopkproofs", k=9).add("rel a = {0.4::1}\nrel b = {0.5::1}\nrel r() = a(1), b(1)")
    tag = p.relation("r").collect()[0]["tag"]
    assert math.isclose(tag["p"], 0.2) and sorted(round(v, 6) for v in tag["gradient"].values()) == [0.4, 0.5]
    q = Program(spark, "diffaddmultprob").add("rel a = {0.4::1}\nrel b = {0.5::1}\nrel r() = a(1), b(1)")
    tag = q.relation("r").collect()[0]["tag"]
    assert math.isclose(tag["p"], 0.2) and sorted(round(v, 6) for v in tag["gradient"].values()) == [0.4, 0.5]


def test_exclusive_groups_take_one_pass(monkeypatch):
    """Sums rank a group's proofs once, and a group of exclusive facts isn't gone through for each of its facts."""
    looked = []
    chance = tags.Proofs._chance
    monkeypatch.setattr(tags.Proofs, "_chance", staticmethod(lambda c: looked.append(1) or chance(c)))
    monkeypatch.setattr(tags, "_given_fact", lambda *_: pytest.fail("one fact after the other"))
    n = 3_000
    a = tags.Proofs()
    total = a.py_sum([[[(2 * k, 1 / (2 * n), 7, False)]] for k in range(n)] + [[[(0, 1 / (2 * n), 7, False)]]])
    assert len(total) == n and len(looked) == n
    assert math.isclose(a.py_weight(total), 0.5, abs_tol=1e-9)


def test_exclusive_groups_with_negation():
    """Against all worlds: each one fact of the group or none, and each other fact or not."""
    group, free = {1: 0.2, 2: 0.3, 3: 0.1}, {10: 0.6, 11: 0.5}
    clauses = [[(1, 0.2, 7, False), (10, 0.6, None, False)], [(2, 0.3, 7, True), (11, 0.5, None, False)], [(3, 0.1, 7, False), (1, 0.2, 7, True)], [(1, 0.2, 7, True), (2, 0.3, 7, True), (10, 0.6, None, True)], [(1, 0.2, 7, False), (2, 0.3, 7, False)]]
    for size in range(1, len(clauses) + 1):
        for some in itertools.combinations(clauses, size):
            want = 0.0
            for one in [None, *group]:
                for on in itertools.product((True, False), repeat=2):
                    true = {one} | {f for f, x in zip(free, on, strict=True) if x}
                    p = group[one] if one else 1 - sum(group.values())
                    p *= math.prod(free[f] if x else 1 - free[f] for f, x in zip(free, on, strict=True))
                    want += p * any(all((x[0] in true) != x[3] for x in c) for c in some)
            assert math.isclose(tags.wmc(tags.Proofs._set(some)), want, abs_tol=1e-9)
