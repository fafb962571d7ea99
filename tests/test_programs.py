"""Programs over small worlds of our own, against rows that plain Python works out or that are plain to see."""

import itertools
import math

import pytest

from ruleweave.program import Program, ProgramError

#: Ferry lines between harbours, with minutes; a ring with a spur and a harbour apart.
LINES = {(1, 2): 30, (2, 5): 45, (5, 1): 20, (5, 8): 60, (8, 9): 15, (11, 12): 5}
FERRY = "rel ferry = {" + ", ".join(f"({a}, {b}, {m})" for (a, b), m in LINES.items()) + "}\nrel line(a, b) = ferry(a, b, _)\n"
#: Loaves by bakery and flour, with grams; and which flours are stocked where.
LOAVES = [("mill", "rye", 750), ("mill", "oat", 500), ("mill", "spelt", 750), ("quay", "rye", 900), ("hill", "oat", 400), ("hill", "rye", 400)]
BAKERY = "rel loaf = {" + ", ".join(f'("{b}", "{f}", {g})' for b, f, g in LOAVES) + '}\nrel bakery = {"mill", "quay", "hill", "pier"}\n'
ROPE = "type Rope = Knot(i32) | Tie(Rope, Rope)\n"


def closure(edges):
    found = set(edges)
    while more := {(a, d) for a, b in found for c, d in edges if b == c} - found:
        found |= more
    return sorted(found)


def by_bakery(f):
    out = {}
    for b, flour, g in LOAVES:
        out.setdefault(b, []).append((flour, g))
    return [(b, f(rows)) for b, rows in out.items()]


CASES = {
    "reach on the left": (FERRY + "rel out(a, b) = line(a, b) or (out(a, m) and line(m, b))", closure(LINES)),
    "reach by doubling": (FERRY + "rel out(a, b) = line(a, b)\nrel out(a, c) = out(a, b), out(b, c)", closure(LINES)),
    "two rules for one relation": (FERRY + "rel out(a) = line(a, _)\nrel out(b) = line(_, b)", [(x,) for x in sorted({x for e in LINES for x in e})]),
    "equations bind in any order": ("rel seed(6)\nrel out(p, q) = q == p * 2, seed(s), p - 1 == s", [(7, 14)]),
    "a value alone": ("rel out(v) = v == 3 * 7 - 1", [(20,)]),
    "a variable with itself": (FERRY + "rel out(a, b) = line(a, b), b == b, a > 5", [(8, 9), (11, 12)]),
    "constants in atoms": (BAKERY + 'rel out(f, g) = loaf("mill", f, g), loaf("quay", f, _)', [("rye", 750)]),
    "products are sets": (BAKERY + 'rel out(g + h) = loaf("mill", _, g), loaf("hill", _, h)', sorted({(g + h,) for b, _, g in LOAVES if b == "mill" for c, _, h in LOAVES if c == "hill"})),
    "arithmetic recursion": ("rel pile(0, 1)\nrel pile(n, p + n) = pile(n - 1, p), n <= 6\nrel out(p) = pile(6, p)", [(22,)]),
    "recursion down a heading": ("rel half(40)\nrel half(x / 2) = half(x), x > 1\nrel out(x) = half(x)", [(40,), (20,), (10,), (5,), (2,), (1,)]),
    "count of distinct": (BAKERY + "rel out(n) = n := count(f: loaf(_, f, _))", [(3,)]),
    "count by group": (BAKERY + "rel out(b, n) = n := count(f: loaf(b, f, _))", by_bakery(len)),
    "count with empty groups": (BAKERY + "rel out(b, n) = n := count(f: loaf(b, f, g), g > 450 where b: bakery(b))", [(b, sum(x == b and g > 450 for x, _, g in LOAVES)) for b in ("mill", "quay", "hill", "pier")]),
    "sum of distinct values": (BAKERY + "rel out(b, s) = s := sum(g: loaf(b, _, g))", by_bakery(lambda r: sum({g for _, g in r}))),
    "sum by argument": (BAKERY + "rel out(b, s) = s := sum[f](g: loaf(b, f, g))", by_bakery(lambda r: sum(g for _, g in r))),
    "sum of nothing": (BAKERY + "rel out(s) = s := sum(g: loaf(_, _, g), g > 5000)", [(0,)]),
    "product": ("rel side = {3, 4, 5}\nrel out(v) = v := prod(x: side(x))", [(60,)]),
    "mean of reals": ("rel depth = {(1, 2.5), (2, 4.0), (3, 2.5)}\nrel out(m) = m := avg[k](d: depth(k, d))", [(3.0,)]),
    "mean of integers is cut": (BAKERY + 'rel out(m) = m := avg[f](g: loaf("mill", f, g))', [(2000 // 3,)]),
    "least with ties": (BAKERY + "rel out(b, f, g) = (f, g) := min[f](g: loaf(b, f, g))", [(b, f, g) for b, rows in by_bakery(list) for f, g in rows if g == min(x for _, x in rows)]),
    "which is greatest": (BAKERY + "rel out(b, f) = f := argmax[f](g: loaf(b, f, g))", [(b, f) for b, rows in by_bakery(list) for f, g in rows if g == max(x for _, x in rows)]),
    "greatest of pairs": (BAKERY + "rel out(b, g, f) = (g, f) := max(g, f: loaf(b, f, g))", [(b, *max((g, f) for f, g in rows)) for b, rows in by_bakery(list)]),
    "heading reduces": (BAKERY + "rel most = max(g: loaf(_, _, g))\nrel out(g) = most(g)", [(900,)]),
    "first two": (BAKERY + 'rel out(f) = f := top<2>(f: loaf("mill", f, _))', [("oat",), ("rye",)]),
    "joined texts": (BAKERY + 'rel out(b, t) = t := string_join<"+">(f: loaf(b, f, _))', by_bakery(lambda r: "+".join(sorted(f for f, _ in r)))),
    "joined by argument": (BAKERY + 'rel out(t) = t := string_join<" ">[g](f: loaf("hill", f, h), g == 0 - h), bakery(_)', [("oat rye",)]),
    "numbered": (BAKERY + 'rel out(i, f) = (i, f) := enumerate(f: loaf("mill", f, _))', [(0, "oat"), (1, "rye"), (2, "spelt")]),
    "sorted descends": (BAKERY + 'rel out(i, b, g) = (i, b, g) := sort[b](g: loaf(b, "rye", g))', [(0, "quay", 900), (1, "mill", 750), (2, "hill", 400)]),
    "order only, ascending": (BAKERY + 'rel out(i, b) = (i, b) := argsort<asc>[b](g: loaf(b, "rye", g))', [(0, "hill"), (1, "mill"), (2, "quay")]),
    "whether one exists": (FERRY + "rel out(b) = b := exists(m: ferry(_, _, m), m > 50)", [(True,)]),
    "whether none exists": (FERRY + "rel out(b) = b := exists(m: ferry(_, _, m), m > 500)", [(False,)]),
    "exists by group": (BAKERY + 'rel out(b, e) = e := exists(g: loaf(b, "oat", g) where b: bakery(b))', [("mill", True), ("quay", False), ("hill", True), ("pier", False)]),
    "exists filters": (BAKERY + "rel out(b) = bakery(b), exists(f: loaf(b, f, g), g < 450)", [("hill",)]),
    "no one exists": (BAKERY + "rel out(b) = bakery(b), not exists(f: loaf(b, f, _))", [("pier",)]),
    "for all": (BAKERY + "rel out(b) = bakery(b), forall(f: loaf(b, f, g) implies g > 450)", [("mill",), ("quay",), ("pier",)]),
    "for all as a value": (FERRY + "rel out(v) = v := forall(a: line(a, b) implies a < b)", [(all(a < b for a, b in LINES),)]),
    "implication": (BAKERY + 'rel out(b) = bakery(b), (loaf(b, "oat", _) implies loaf(b, "spelt", _))', [("mill",), ("quay",), ("pier",)]),
    "what has no match": (BAKERY + "rel busy(b) = loaf(b, _, _)\nrel out(b) = bakery(b), not busy(b)", [("pier",)]),
    "negated with a constant": (FERRY + "rel out(b) = line(_, b), not line(b, 8)", [(x,) for x in sorted({b for _, b in LINES if (b, 8) not in LINES})]),
    "alternating relations": ("rel up(0)\nrel down(x + 3) = up(x), x < 12\nrel up(x - 1) = down(x)\nrel out(x) = up(x)", [(x,) for x in range(0, 13, 2)]),
    "heads of two": (FERRY + "rel from(a), to(b) = line(a, b), b > 8\nrel out(a, b) = from(a), to(b)", [(a, b) for a in (8, 11) for b in (9, 12)]),
    "alternative heads": ('rel gate = {4}\nrel { out(g, "open"); out(g, "shut") } = gate(g)', [(4, "open"), (4, "shut")]),
    "if then else": (FERRY + 'rel out(m, if m >= 30 then "long" else "short") = ferry(5, _, m)', [(20, "short"), (60, "long")]),
    "numbers as text": ("rel n = {7, 70}\nrel out(x as String) = n(x)", [("7",), ("70",)]),
    "texts that are no numbers": ('rel t = {"12", "a dozen", "-4"}\nrel out(x as i32) = t(x)', [(12,), (-4,)]),
    "casts wrap": ("rel n = {261, 255}\nrel out(x, x as u8) = n(x)", [(261, 5), (255, 255)]),
    "sums saturate": ("rel n = {(100 as i8), (20 as i8)}\nrel out(x + y) = n(x), n(y), x > y", [(120,)]),
    "sums stay in range": ("rel n = {2147483000}\nrel out(x + 1000) = n(x)", [(2147483647,)]),
    "no number drops": ("rel r = {(3.0, 0.0), (0.0, 0.0), (-3.0, 0.0)}\nrel out(x / y) = r(x, y)", [(math.inf,), (-math.inf,)]),
    "logarithms of positives": ("rel r = {1.0, -2.0}\nrel out($log(x)) = r(x)", [(0.0,)]),
    "a half open range": ("rel out(i) = i in 7..9", [(7,), (8,)]),
    "a closed range": ("rel out(i) = i in 7..=9", [(7,), (8,), (9,)]),
    "ranges from data": (FERRY + "rel out(a, i) = line(a, b), range(a, b, i), a > 7", [(8, 8), (11, 11)]),
    "outside a range": (FERRY + "rel out(a) = line(a, _), not range(2, 9, a)", [(1,), (11,)]),
    "letters": ('rel out(i, c) = string_chars("añ€", i, c)', [(0, "a"), (1, "ñ"), (2, "€")]),
    "places of a part": ('rel out(b, e) = string_find("banana", "an", b, e)', [(1, 3), (3, 5)]),
    "split keeps what is empty": ('rel out(x) = string_split(";x;;y", ";", x)', [("",), ("x",), ("y",)]),
    "months end early": ('rel d(t"2023-01-31")\nrel out($datetime_month(x + d"1 month"), $datetime_day(x + d"1 month")) = d(x)', [(2, 28)]),
    "names for numbers": ("type Tide = EBB | SLACK = 7 | FLOOD\nrel out = {EBB, SLACK, FLOOD}", [(0,), (7,), (8,)]),
    "terms are walked": (ROPE + "rel load(r, k) = case r is Knot(k)\nrel load(r, a + b) = case r is Tie(x, y) and load(x, a) and load(y, b)\nconst R = Tie(Tie(Knot(2), Knot(9)), Knot(4))\nrel out(n) = load(R, n)", [(15,)]),
    "terms in heads": (ROPE + "const R = Tie(Knot(2), Tie(Knot(9), Knot(4)))\nrel size(Knot(k), 1)\nrel size(Tie(x, y), a + b) = size(x, a), size(y, b)\nrel out(n) = size(R, n)", [(3,)]),
    "patterns inside patterns": (ROPE + "const R = Tie(Knot(2), Knot(9))\nconst S = Tie(R, Knot(3))\nrel out(a, b) = case r is Tie(Knot(a), Knot(b))", [(2, 9)]),
    "new terms": ("type Pair = Both(i32, i32)\nrel made(new Both(a, b)) = ferry(a, b, _)\n" + FERRY + "rel out(b, a) = made(p), case p is Both(a, b), a > 5", [(9, 8), (12, 11)]),
    "terms from texts": (ROPE + 'rel told = {"Tie(Knot(5), Tie(Knot(-1), Knot(8)))", "Knot(3)", "Knot(", "Bow(1)"}\nrel rope(t, $parse_entity(t)) = told(t)\nrel load(r, k) = case r is Knot(k)\nrel load(r, a + b) = case r is Tie(x, y) and load(x, a) and load(y, b)\nrel out(n) = rope(_, r), load(r, n)', [(12,), (3,)]),
    "texts in terms from texts": ('type Tag = Mark(String, f64, bool, Tag) | End()\nrel told("Mark(\\"a, b\\", 0.5, true, End())")\nrel tag($parse_entity(t)) = told(t)\nrel out(s, w, b) = tag(t), case t is Mark(s, w, b, _)', [("a, b", 0.5, True)]),
    "shapes of tensors": ("rel out(k, d, n) = grid(k, g), d == $dim(g), tensor_shape(g, 1, n)", [(1, 2, 3)]),
}


@pytest.mark.parametrize("name", CASES)
def test_rows(spark, name):
    text, want = CASES[name]
    p = Program(spark)
    if "grid" in text:
        p.add_table("grid", spark.sql("SELECT 1 AS k, array(array(1D, 2D, 3D), array(4D, 5D, 6D)) AS g"))
    got = [tuple(r) for r in p.add(text).relation("out").collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)


#: Sensors that may be on, by probability.
SENSORS = {1: 0.6, 2: 0.3, 3: 0.5, 4: 0.9}
SENSOR = "rel on = {" + ", ".join(f"{p}::{k}" for k, p in SENSORS.items()) + "}\n"


def worlds(facts, plus, times):
    """The tag of every result in all worlds, by enumeration."""

    def over(f):
        out = {}
        for chosen in itertools.product([True, False], repeat=len(facts)):
            tag = 1.0
            for (_, p), c in zip(facts.items(), chosen, strict=True):
                tag = times(tag, p if c else 1 - p)
            value = f([k for k, c in zip(facts, chosen, strict=True) if c])
            if value is not None:
                out[value] = plus(out[value], tag) if value in out else tag
        return sorted(out.items())

    return over


SOFT = {"minmaxprob": worlds(SENSORS, max, min), "maxmultprob": worlds(SENSORS, max, lambda a, b: a * b), "addmultprob": worlds(SENSORS, lambda a, b: min(1.0, a + b), lambda a, b: a * b)}
FOLDS = {
    "count": ("rel out(v) = v := count(k: on(k))", len),
    "sum": ("rel out(v) = v := sum(k: on(k))", sum),
    "prod": ("rel out(v) = v := prod(k: on(k))", math.prod),
    "avg": ("rel out(v) = v := avg(k: on(k))", lambda x: int(sum(x) / len(x)) if x else None),
    "string_join": ('rel out(v) = v := string_join<"">(k: on(k))', lambda x: "".join(map(str, x))),
}


@pytest.mark.parametrize("op", FOLDS)
@pytest.mark.parametrize("provenance", SOFT)
def test_aggregates_over_all_worlds(spark, provenance, op):
    text, fold = FOLDS[op]
    got = [(r["c0"], r["tag"]) for r in Program(spark, provenance).add(SENSOR + text).relation("out").collect()]
    want = SOFT[provenance](fold)
    assert [k for k, _ in sorted(got)] == [k for k, _ in want]
    assert all(math.isclose(a, b, abs_tol=1e-6) for (_, a), (_, b) in zip(sorted(got), want, strict=True))


def test_extremes_over_all_worlds(spark):
    """Each value where it is there and no better one is; ties share what is before them."""
    tags = {("a", 1): 0.5, ("b", 1): 0.4, ("c", 3): 0.8, ("d", 7): 0.25}
    text = "rel r = {" + ", ".join(f'{p}::("{k}", {v})' for (k, v), p in tags.items()) + "}\n"
    got = {r["c0"]: r["tag"] for r in Program(spark, "maxmultprob").add(text + "rel out(k) = k := argmin[k](v: r(k, v))").relation("out").collect()}
    none = 0.5 * 0.6
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 0.5, "b": 0.4, "c": round(none * 0.8, 6), "d": round(none * 0.2 * 0.25, 6)}
    got = {(r["c0"], r["c1"]): r["tag"] for r in Program(spark, "minmaxprob").add(text + "rel out(k, v) = (k, v) := max[k](v: r(k, v))").relation("out").collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {("d", 7): 0.25, ("c", 3): 0.75, ("a", 1): 0.2, ("b", 1): 0.2}
    exact = {r["c0"]: r["tag"] for r in Program(spark, "topkproofs", k=20).add(text + "rel out(v) = v := min(v: r(_, v))").relation("out").collect()}
    assert math.isclose(exact[3], 0.3 * 0.8, abs_tol=1e-6) and math.isclose(exact[7], 0.3 * 0.2 * 0.25, abs_tol=1e-6)


def test_large_groups_of_soft_aggregates(spark):
    n = 200
    rows = spark.range(n).selectExpr("cast(id % 7 as int) as v", "id as k", "0.5D as p")
    p = Program(spark, "addmultprob").add_table("r", rows, "p").add("rel c(n) = n := count(k: r(_, k))\nrel s(t) = t := sum[k](v: r(v, k))")
    counts = {r["c0"]: r["tag"] for r in p.relation("c").collect()}
    assert len(counts) == n + 1 and math.isclose(counts[100], math.comb(200, 100) / 2**200, rel_tol=1e-6)
    sums = {r["c0"]: r["tag"] for r in p.relation("s").collect()}
    want = {0: 1.0}
    for k in range(n):
        grown = {}
        for s, w in want.items():
            for t in (s, s + k % 7):
                grown[t] = grown.get(t, 0.0) + w / 2
        want = grown
    assert set(sums) == set(want) and all(math.isclose(sums[k], want[k], abs_tol=1e-9) for k in want)


TAGGED = {
    "hard count": ("minmaxprob", SENSOR + "rel out(n) = n := count!(k: on(k))", [(4, 1.0)]),
    "shares": ("minmaxprob", 'rel vote = {0.2::("north", 1), 0.6::("north", 2), 0.5::("south", 1)}\nrel out(w, v) = v := normalize(v: vote(w, v))', [("north", 1, 0.25), ("north", 2, 0.75), ("south", 1, 1.0)]),
    "places by weight": ("minmaxprob", SENSOR + "rel out(i, k) = (i, k) := rank(k: on(k))", [(0, 4, 0.9), (1, 1, 0.6), (2, 3, 0.5), (3, 2, 0.3)]),
    "places from the least": ("minmaxprob", SENSOR + "rel out(i, k) = (i, k) := rank<asc>(k: on(k))", [(0, 2, 0.3), (1, 3, 0.5), (2, 1, 0.6), (3, 4, 0.9)]),
    "weighted mean": ("minmaxprob", "rel w = {0.5::(1, 10.0), 0.25::(2, 40.0), 0.25::(3, 20.0)}\nrel out(m) = m := weighted_avg![k](x: w(k, x))", [(20.0, 1.0)]),
    "all joins": ("minmaxprob", 'rel ink = {0.7::(1, "x"); 0.2::(1, "y")}\nrel ink = {0.5::(2, "z")}\nrel out(t) = t := string_join<all>[k](c: ink(k, c))', [("xz", 0.5), ("yz", 0.2)]),
    "fewest hops": ("tropical", "rel e = {1::(1, 2), 1::(2, 3), 1::(3, 4), 1::(1, 3)}\nrel out(y) = e(1, y) or out(x) and e(x, y)", [(2, 1), (3, 1), (4, 2)]),
    "derivations": ("natural", "rel e = {1::(1, 2), 1::(1, 3), 1::(2, 4), 1::(3, 4), 1::(2, 5)}\nrel out(z) = e(1, y), e(y, z)", [(4, 2), (5, 1)]),
    "widest way around a ring": ("minmaxprob", "rel e = {0.4::(1, 2), 0.9::(2, 3), 0.8::(3, 1), 0.6::(1, 3), 0.7::(3, 2)}\nrel out(y) = e(1, y) or out(x) and e(x, y)", [(1, 0.6), (2, 0.6), (3, 0.6)]),
    "tags of rules": ("maxmultprob", "rel n = {4.0, 5.0}\nrel 1.0 / x::out(x) = n(x)", [(4.0, 0.25), (5.0, 0.2)]),
    "less what is negated": ("minmaxprob", SENSOR + "rel broken = {0.8::1, 0.1::4}\nrel out(k) = on(k), not broken(k)", [(1, 0.2), (2, 0.3), (3, 0.5), (4, 0.9)]),
    "only one of them": ("topkproofs", "rel lamp = {0.3::1; 0.6::2}\nrel either() = lamp(1) or lamp(2)\nrel both() = lamp(1), lamp(2)\nrel out(9) = either()\nrel out(k) = lamp(k)\nrel out(8) = both()", [(1, 0.3), (2, 0.6), (8, 0.0), (9, 0.9)]),
    "heads that exclude each other": ("topkproofs", 'rel coin = {1, 2}\nrel { side(c, "h"); side(c, "t") } = coin(c)\nrel out(x, y) = side(1, x), side(2, y)', [(x, y, 0.25) for x in "ht" for y in "ht"]),
    "soft order": ("addmultprob", "rel a = {(1, 2.0), (2, 2.0)}\nrel out(k, l) = a(k, x), a(l, y), k < l, soft_gt(x, y)", [(1, 2, 0.5)]),
    "soft equality": ("addmultprob", "rel a = {(1, 2.0), (2, 4.0)}\nrel out(k) = a(k, x), soft_eq(x, 2.0)", [(1, 1.0), (2, round(1 / math.cosh(1.0), 5))]),
    "soft difference": ("addmultprob", "rel a = {(1, 2.0), (2, 4.0)}\nrel out(k) = a(k, x), soft_neq(x, 2.0)", [(1, 0.0), (2, round(1 - 1 / math.cosh(1.0), 5))]),
    "costs of chances": ("realtropical", "rel e = {0.5::(1, 2), 0.25::(2, 3), 0.1::(1, 3)}\nrel out(y) = e(1, y) or out(x) and e(x, y)", [(2, round(-math.log(0.5), 5)), (3, round(-math.log(0.125), 5))]),
    "most heaviest": ("minmaxprob", SENSOR + "rel out(k) = k := top<2>(k: on(k))", [(1, 0.6), (4, 0.9)]),
}


@pytest.mark.parametrize("name", TAGGED)
def test_tags(spark, name):
    provenance, text, want = TAGGED[name]
    got = [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in Program(spark, provenance).add(text).relation("out").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rules_take_tags_from_outside(spark):
    p = Program(spark, "maxmultprob").add("rel r = {0.5::1}\n@tagged\nrel out(x) = r(x)\n@tagged\nrel out(x + 10) = r(x)")
    assert p.relation("out").count() == 0
    p.tag_rule("out", 0.4).tag_rule("out", 0.8, 1).add_rule("out(x + 20) = r(x)", tag=0.1)
    assert {r["c0"]: round(r["tag"], 6) for r in p.relation("out").collect()} == {1: 0.2, 11: 0.4, 21: 0.05}


@pytest.mark.parametrize("shape,want", [("logistic", 1 / (1 + math.exp(-2))), ("reciprocal", 2 / 5 + 0.5), ("cauchy", math.atan(2) / math.pi + 0.5), ("optimal", 1 - 1 / 32)])
def test_sigmoids(spark, shape, want):
    p = Program(spark, "addmultprob").soft_comparison(shape, beta=2.0).add("rel a(3.0)\nrel out() = a(x), soft_gt(x, 2.0)\nrel less() = a(x), soft_lt(x, 2.0)")
    assert math.isclose(p.relation("out").collect()[0]["tag"], want, abs_tol=1e-6)
    assert math.isclose(p.relation("less").collect()[0]["tag"], 1 - want, abs_tol=1e-6)


def test_monitors_and_kept_tags(spark):
    seen = []
    p = Program(spark, "topkproofs").monitor(lambda event, data: seen.append((event, data)))
    p.add("rel e = {0.5::(1, 2), 0.5::(2, 3)}\nrel out(y) = e(1, y) or out(x) and e(x, y)")
    assert p.relation("out").count() == 2
    assert [d["rows"]["out"] for e, d in seen if e == "round"] == [1, 1, 0] and any(e == "relation" and d["name"] == "e" for e, d in seen)
    assert {r["c0"]: len(r["tag"][0]) for r in p.tags("out").collect()} == {2: 1, 3: 2}


def test_false_rows_stay_without_early_discard(spark):
    text = "rel e = {0::1, 1::2}\nrel out(x) = e(x)"
    assert Program(spark, "boolean").add(text).relation("out").count() == 1
    assert Program(spark, "boolean", early_discard=False).add(text).relation("out").count() == 2


@pytest.mark.parametrize(
    "text,message",
    [
        ("rel r = {1}\nrel out(y) = y := top<2, 4>(z: r(z))", "too many parameters"),
        ("rel r = {1}\nrel out(y) = y := argmax(z: r(z))", "needs variables in brackets"),
        ('rel r = {"a"}\nrel out(y) = y := string_join<loud>(z: r(z))', "no parameter named loud"),
        ("rel p(x) = q(x), not p(x)\nrel q = {3}", "not stratified"),
        ("rel p(x, y) = q(x)\nrel q = {3}", "not bound"),
        ("type w(i32)\nrel w(8)\nrel p(0.5 * x) = w(x)", "type"),
        ("rel p(1)\nrel p(1, 2)", "columns"),
        ("rel p = {", "expected"),
        ("rel p(x) = q(x), x == $missing(x)\nrel q = {3}", "unknown function"),
        ('rel q(t"2024-02-29")\nrel d::p() = q(d)', "DateTime"),
        ("type T = A(i32)\nrel out(e) = e == $parse_entity(s)", "binds"),
    ],
)
def test_errors(spark, text, message):
    with pytest.raises(ProgramError, match=message):
        p = Program(spark, "minmaxprob" if "::" in text else "unit").add(text)
        p.run()
        for name in p.results:
            p.relation(name).collect()


def test_demand_computes_only_what_is_asked(spark):
    p = Program(spark).add('rel pile(0, 1)\n@demand("bf")\nrel pile(n, p + n) = pile(n - 1, p), n > 0\nquery pile(7, y)')
    assert [tuple(r) for r in p.query("pile(7, y)").collect()] == [(7, 29)]
    q = Program(spark).add("type reach(bound a: i32, b: i32)\n" + FERRY + "rel reach(a, b) = line(a, b) or (reach(a, m) and line(m, b))\nrel out(b) = reach(8, b)")
    assert sorted(tuple(r) for r in q.relation("out").collect()) == [(9,)]
    assert {r["c0"] for r in q.relation("reach").collect()} == {8}


@pytest.mark.parametrize("scheduler", ["lfp", "dfs", "a-star", "beam"])
def test_schedulers_reach_the_same_fixpoint(spark, scheduler):
    p = Program(spark, "minmaxprob").add("rel e = {0.4::(1, 2), 0.9::(2, 3), 0.8::(3, 1), 0.6::(1, 3), 0.7::(3, 2)}\nrel out(y) = e(1, y) or out(x) and e(x, y)")
    p.run(scheduler=scheduler, beam=2)
    assert sorted((r["c0"], round(r["tag"], 3)) for r in p.relation("out").collect()) == [(1, 0.6), (2, 0.6), (3, 0.6)]


def test_many_rounds_of_tags(spark):
    """More rounds than parts are kept apart; a later, better way changes what was found."""
    n = 12
    ways = [(k, k + 1, 0.9) for k in range(n)] + [(0, n // 2, 0.2)]
    text = "rel e = {" + ", ".join(f"{p}::({a}, {b})" for a, b, p in ways) + "}\nrel out(y) = e(0, y) or out(x) and e(x, y)"
    got = {r["c0"]: round(r["tag"], 6) for r in Program(spark, "maxmultprob").add(text).relation("out").collect()}
    best = {0: 1.0}
    for a, b, p in sorted(ways):
        best[b] = max(best.get(b, 0.0), best[a] * p)
    assert got == {k: round(v, 6) for k, v in best.items() if k}


def test_limits_and_goals(spark):
    text = "rel step = {(1, 3), (3, 4), (4, 7), (7, 8), (8, 9)}\nrel walk(a, b) = step(a, b) or (walk(a, m) and step(m, b))"
    p = Program(spark).add(text).run(limit=1)
    assert p.relation("walk").count() == 5 + 4
    q = Program(spark).add(text.replace("rel walk", "@goal\nrel walk", 1)).run(stop_at_goal=True)
    assert {(1, 3)} <= {tuple(r) for r in q.relation("walk").collect()} and q.rounds["walk"] == 0


def test_adding_facts_computes_dependents_again(spark):
    p = Program(spark).add("rel step = {(1, 3), (3, 4)}\nrel walk(a, b) = step(a, b) or (walk(a, m) and step(m, b))\nrel other(x) = apart(x)\nrel apart = {5}")
    p.run()
    kept = p.memo["other"][1]
    p.add_facts("step", [(4, 6)])
    assert {(1, 6), (4, 6)} <= {tuple(r) for r in p.relation("walk").collect()}
    assert p.run().memo["other"][1] is kept
    p.add("rel walk(x, x) = apart(x)")
    assert (5, 5) in {tuple(r) for r in p.relation("walk").collect()}


def test_imports_and_cli(spark, tmp_path, capsys, monkeypatch):
    import io

    from ruleweave import cli

    (tmp_path / "lines.txt").write_text('import "walks.txt"\nrel step = {(1, 3), (3, 4)}')
    (tmp_path / "walks.txt").write_text('import "lines.txt"\nrel walk(a, b) = step(a, b) or (walk(a, m) and step(m, b))\nquery walk(1, y)')
    cli.main([str(tmp_path / "walks.txt"), "--monitor"])
    shown = capsys.readouterr().out
    assert "|1  |4  |" in shown and "round" in shown
    monkeypatch.setattr("sys.stdin", io.StringIO("rel n = {4, 6}\nrel m(x * 2) = n(x)\n?m\nrel oops(\n?m(8)\n"))
    cli.main([])
    shown = capsys.readouterr().out
    assert "|12 |" in shown and "expected" in shown and shown.count("|8  |") == 2


def test_csv_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n2,y\n")
    with pytest.raises(ProgramError, match="columns"):
        Program(spark).add(f'@file("{tmp_path}/a.csv")\ntype a(i32)').relation("a").collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        Program(spark).add(f'@file("{tmp_path}/a.csv")\ntype a(i32, i32)').relation("a").collect()


def test_python_extensions(spark):
    p = Program(spark).function("twice", ["i32"], "i32", python=lambda x: None if x == 2 else 2 * x)
    p.predicate("below", ["i32"], ["i32"], lambda n: range(n))
    p.aggregate("spread", "i32", lambda x: __import__("pyspark").sql.functions.max(x) - __import__("pyspark").sql.functions.min(x))
    p.attribute("loud", lambda item: None)
    p.add("rel r = {1, 2, 3}\n@loud\nrel a($twice(x)) = r(x)\nrel b(x, y) = r(x), below(x, y)\nrel c(d) = d := spread(x: r(x))")
    assert sorted(r[0] for r in p.relation("a").collect()) == [2, 6]
    assert p.relation("b").count() == 6
    assert p.relation("c").collect()[0][0] == 2


def test_batches_do_not_meet(spark):
    p = Program(spark).add("rel step = {(1, 3), (3, 4)}\ntype s(i32)\nrel r(x) = s(x)\nrel r(y) = r(x), step(x, y)\nrel n(c) = c := count(x: r(x))")
    inputs = spark.createDataFrame([("a", 1), ("b", 4)], "k string, x int")
    assert sorted(tuple(r) for r in p.batch({"s": inputs}, "n", "k", ["n"]).collect()) == [("a", 3), ("b", 1)]


def test_stream_of_facts_and_restart(spark, tmp_path):
    from ruleweave.streaming.maintenance import Maintained

    text = "type step(i32, i32)\nrel walk(a, b) = step(a, b) or (walk(a, m) and step(m, b))"
    seen = []
    source = tmp_path / "in"

    def follow(n, a, b):
        spark.createDataFrame([(a, b)], "a int, b int").write.parquet(str(source / str(n)))
        stream = spark.readStream.schema("a int, b int").parquet(str(source / "*"))
        return Maintained(Program(spark).add(text), "step", "walk").start(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "c"))

    query = follow(1, 1, 3)
    query.processAllAvailable()
    spark.createDataFrame([(3, 4)], "a int, b int").write.parquet(str(source / "2"))
    query.processAllAvailable()
    query.stop()
    assert seen == [1, 3]
    # another program goes on from the checkpoint with the facts of the first
    query = follow(3, 4, 6)
    query.processAllAvailable()
    query.stop()
    assert seen == [1, 3, 6]


def test_pairs_are_not_gathered(spark):
    """Pairs of a self-join stream out of it; keys that repeat are merged, here by two groups and by equal rows."""
    rows = [(1, 7), (2, 7), (3, 7), (4, 8), (5, 8), (2, 8), (5, 8)]
    text = "rel out(a, b) = one(a, n), one(b, n), a < b"
    plan = Program(spark).add_table("one", spark.createDataFrame(rows[:5], "k int, n int")).add(text).explain("out")
    assert plan.index("Join") < (plan + "HashAggregate").index("HashAggregate")
    got = Program(spark).add_table("one", spark.createDataFrame([*rows, (1, 8)], "k int, n int")).add(text).relation("out").collect()
    each = {(a, b) for a, n in [*rows, (1, 8)] for b, m in [*rows, (1, 8)] if n == m and a < b}
    assert sorted(map(tuple, got)) == sorted(each)


def test_parts_of_texts_are_not_gathered(spark):
    """Rows that a predicate computes stream out; ids that repeat are merged."""
    rows = [(1, "a b a"), (2, "b"), (3, "c a"), (3, "a d"), (2, "b")]
    text = 'rel out(k, w) = doc(k, t), string_split(t, " ", w)'
    plan = Program(spark).add_table("doc", spark.createDataFrame(rows[:3], "k int, t string")).add(text).explain("out")
    assert "Generate" in plan and "HashAggregate" not in plan
    got = Program(spark).add_table("doc", spark.createDataFrame(rows, "k int, t string")).add(text).relation("out").collect()
    assert sorted(map(tuple, got)) == sorted({(k, w) for k, t in rows for w in t.split(" ")})


def test_equal_texts_are_parsed_once(spark):
    """Terms of a text that many rows have are computed from its different texts."""
    text = ROPE + "rel rope(k, $parse_entity(t)) = told(k, t)\nrel out(k, n) = rope(k, r), case r is Knot(n)"
    rows = [(k, f"Knot({k % 3})") for k in range(40)] + [(40, "Knot("), (41, "Tie(Knot(1), Knot(2))")]
    p = Program(spark).add_table("told", spark.createDataFrame(rows, "k int, t string")).add(text)
    assert sorted(map(tuple, p.relation("out").collect())) == sorted((k, k % 3) for k in range(40))
    assert p.relation("rope").count() == 41
    for name in ("rope", "Knot"):
        lines = p.run(only=[name]).explain(name).split("== Physical Plan ==")[1].split("\n\n")[0].split("\n")
        at = next(k for k, x in enumerate(lines) if "BatchEvalPython" in x or "ArrowEvalPython" in x)
        assert "HashAggregate" in "".join(lines[at + 1 : at + 3])
