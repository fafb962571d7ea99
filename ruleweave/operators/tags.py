"""Tag algebras: how the tags of tuples combine.

An algebra gives the Spark type of its tags and, as Column functions, what joins (``times``), merges (``plus``), negation
and the fixpoint test do. Algebras over numbers and dual numbers (a number with a map of derivatives) stay in the JVM. Proof
algebras have the same operations on Python values, which run as UDFs; where they keep the k best proofs, groups are
merged in two steps, so that no step sees more than a part of a group or a few times k proofs. The Python
operations (``py_*``) also serve aggregates over all worlds.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = "__tag"


class Algebra:
    """Unit tags: no column; also the base of the others."""

    name = "unit"
    #: The type of the tag column; none for unit tags.
    type: str | None = None
    #: Whether facts may carry tags, and whether a tag that changes goes around a recursion again.
    tagged = False
    again = True
    k: int | None = None
    #: Whether tags hold the facts they come from, so that exclusive alternatives can be told apart.
    proofs = False
    #: Whether every match of a negation has a tag of its own, in Columns over plain numbers.
    plain = False
    #: How many parts of a group are merged first.
    parts = 1

    def one(self) -> Column:
        return F.lit(self.py_one()).cast(self.type)

    def given(self, prob: Column, fact: Column, group: Column) -> Column:
        """The tag of a fact with probability (or value) ``prob``, an id, and the id of its exclusive group."""
        return prob.cast(self.type)

    def times(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def sum(self, tags: Column) -> Column:
        """The aggregate of a group's tags."""
        raise NotImplementedError

    def plus(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def negate(self, a: Column) -> Column | None:
        """The negation, or None if any match drops the row."""
        return None

    def minus(self, a: Column, b: Column) -> Column | None:
        """``a`` without ``b``; b is null where nothing matches."""
        inverse = self.negate(b)
        return None if inverse is None else F.when(b.isNull(), a).otherwise(self.times(a, inverse))

    def saturated(self, old: Column, new: Column) -> Column:
        return old == new

    def zero(self) -> Column:
        return F.lit(self.py_zero()).cast(self.type)

    def discard(self, a: Column) -> Column | None:
        """Whether a tuple need not be kept."""
        return None

    def weight(self, a: Column) -> Column:
        return F.lit(1.0)

    def recover(self, a: Column) -> Column:
        """What users see."""
        return a

    def py_one(self) -> Any:
        return None

    def py_zero(self) -> Any:
        return None

    def py_plus(self, a: Any, b: Any) -> Any:
        return None

    def py_times(self, a: Any, b: Any) -> Any:
        return None

    def py_negate(self, a: Any) -> Any:
        """The negation, or None where there is none."""
        return None

    def py_weight(self, a: Any) -> float:
        return 1.0


class Boolean(Algebra):
    """Whether a tuple holds."""

    name, type, tagged, plain = "boolean", "boolean", True, True

    def times(self, a: Column, b: Column) -> Column:
        return a & b

    def sum(self, tags: Column) -> Column:
        return F.bool_or(tags)

    def plus(self, a: Column, b: Column) -> Column:
        return a | b

    def negate(self, a: Column) -> Column:
        return ~a

    def discard(self, a: Column) -> Column:
        return ~a

    def py_one(self) -> bool:
        return True

    def py_zero(self) -> bool:
        return False

    def py_plus(self, a: bool, b: bool) -> bool:
        return a or b

    def py_times(self, a: bool, b: bool) -> bool:
        return a and b

    def py_negate(self, a: bool) -> bool:
        return not a


class Natural(Algebra):
    """Numbers of derivations. A tag that grows doesn't go around a recursion again."""

    name, type, tagged, again = "natural", "bigint", True, False

    def times(self, a: Column, b: Column) -> Column:
        return a * b

    def sum(self, tags: Column) -> Column:
        return F.sum(tags)

    def plus(self, a: Column, b: Column) -> Column:
        return a + b

    def py_one(self) -> int:
        return 1

    def py_zero(self) -> int:
        return 0

    def py_plus(self, a: int, b: int) -> int:
        return a + b

    def py_times(self, a: int, b: int) -> int:
        return a * b


class Tropical(Algebra):
    """Least costs."""

    name, type, tagged = "tropical", "bigint", True

    def times(self, a: Column, b: Column) -> Column:
        return a + b

    def sum(self, tags: Column) -> Column:
        return F.min(tags)

    def plus(self, a: Column, b: Column) -> Column:
        return F.least(a, b)

    def py_one(self) -> int:
        return 0

    def py_zero(self) -> float:
        return math.inf

    def py_plus(self, a: int, b: int) -> int:
        return min(a, b)

    def py_times(self, a: int, b: int) -> int:
        return a + b

    def weight(self, a: Column) -> Column:
        return -a.cast("double")


class RealTropical(Tropical):
    """Least costs of probabilities: -ln p."""

    name, type = "realtropical", "double"

    def given(self, prob: Column, fact: Column, group: Column) -> Column:
        return -F.ln(prob.cast("double"))

    def py_one(self) -> float:
        return 0.0

    def saturated(self, old: Column, new: Column) -> Column:
        return F.abs(old - new) < 1e-9


class MinMaxProb(Algebra):
    name, type, tagged, plain = "minmaxprob", "double", True, True

    def times(self, a: Column, b: Column) -> Column:
        return F.least(a, b)

    def sum(self, tags: Column) -> Column:
        return F.max(tags)

    def plus(self, a: Column, b: Column) -> Column:
        return F.greatest(a, b)

    def negate(self, a: Column) -> Column:
        return 1 - a

    def weight(self, a: Column) -> Column:
        return a

    def py_one(self) -> float:
        return 1.0

    def py_zero(self) -> float:
        return 0.0

    def py_plus(self, a: float, b: float) -> float:
        return max(a, b)

    def py_times(self, a: float, b: float) -> float:
        return min(a, b)

    def py_negate(self, a: float) -> float:
        return 1 - a

    def py_weight(self, a: float) -> float:
        return a


class MaxMultProb(MinMaxProb):
    """The most probable derivation."""

    name = "maxmultprob"

    def times(self, a: Column, b: Column) -> Column:
        return a * b

    def saturated(self, old: Column, new: Column) -> Column:
        return F.abs(old - new) < 1e-12

    def py_times(self, a: float, b: float) -> float:
        return a * b


class AddMultProb(MaxMultProb):
    """Sums, at most 1, of products. A tag that grows doesn't go around a recursion again."""

    name, again = "addmultprob", False

    def sum(self, tags: Column) -> Column:
        return F.least(F.sum(tags), F.lit(1.0))

    def plus(self, a: Column, b: Column) -> Column:
        return F.least(a + b, F.lit(1.0))

    def py_plus(self, a: float, b: float) -> float:
        return min(1.0, a + b)


class NandMultProb(MaxMultProb):
    """Independent alternatives: 1 - (1 - a)(1 - b)."""

    name, again = "nandmultprob", False

    def sum(self, tags: Column) -> Column:
        return 1 - F.product(1 - tags)

    def plus(self, a: Column, b: Column) -> Column:
        return 1 - (1 - a) * (1 - b)

    def py_plus(self, a: float, b: float) -> float:
        return 1 - (1 - a) * (1 - b)


class NandMinProb(NandMultProb):
    name = "nandminprob"

    def times(self, a: Column, b: Column) -> Column:
        return F.least(a, b)

    def py_times(self, a: float, b: float) -> float:
        return min(a, b)


class UdfAlgebra(Algebra):
    """Tags whose operations run on Python values; also the base of users' own algebras."""

    tagged = True

    def _call(self, function, *columns: Column) -> Column:
        return F.udf(function, self.type)(*columns)

    def one(self) -> Column:
        one = self.py_one()
        return F.udf(lambda: one, self.type)()

    def given(self, prob: Column, fact: Column, group: Column) -> Column:
        return self._call(self.py_given, prob.cast("double"), fact, group)

    def py_given(self, prob: float, fact: int, group: int | None) -> Any:
        raise NotImplementedError

    def times(self, a: Column, b: Column) -> Column:
        return self._call(lambda x, y: None if x is None or y is None else self.py_times(x, y), a, b)

    def plus(self, a: Column, b: Column) -> Column:
        return self._call(lambda x, y: y if x is None else x if y is None else self.py_plus(x, y), a, b)

    def sum(self, tags: Column) -> Column:
        return self._call(self.py_sum, F.collect_list(tags))

    def py_sum(self, values: list) -> Any:
        total = self.py_zero()
        for v in values:
            total = self.py_plus(total, v)
        return total

    def negate(self, a: Column) -> Column:
        return self._call(lambda x: None if x is None else self.py_negate(x), a)

    def weight(self, a: Column) -> Column:
        return F.udf(self.py_weight, "double")(a)


def _literal(x: Any) -> tuple:
    return (x[0], x[1], x[2], x[3])


class Proofs(UdfAlgebra):
    """Disjunctions of proofs, of which the ``k`` most probable are kept (all for None).

    A proof is a set of literals (fact, probability, exclusive group, negated), so tags need no table of facts; proofs that
    hold a fact and its negation, or two facts of one exclusive group, are dropped.
    """

    type = "array<array<struct<fact:bigint,p:double,x:bigint,neg:boolean>>>"
    proofs = True

    def __init__(self, k: int | None = None, name: str = "proofs") -> None:
        self.k, self.name = k, name
        self.parts = 1 if k is None else 64

    def py_one(self) -> list:
        return [[]]

    def py_zero(self) -> list:
        return []

    def py_given(self, prob: float | None, fact: int, group: int | None) -> list:
        return [[(fact, 1.0 if prob is None else prob, group, False)]]

    @staticmethod
    def _chance(clause: tuple) -> float:
        return math.prod((1 - x[1]) if x[3] else x[1] for x in clause)

    def _best(self, clauses: set) -> list:
        ranked = sorted(clauses, key=lambda c: (-self._chance(c), str(c)))
        return [list(c) for c in ranked[: self.k]]

    @staticmethod
    def _set(tag: list) -> set:
        return {tuple(sorted((_literal(x) for x in c), key=str)) for c in tag}

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple | None:
        by_fact, groups = {}, {}
        for x in (*a, *b):
            if x[0] in by_fact and by_fact[x[0]][3] != x[3]:
                return None
            by_fact[x[0]] = x
            if x[2] is not None and not x[3] and groups.setdefault(x[2], x[0]) != x[0]:
                return None
        return tuple(sorted(by_fact.values(), key=str))

    def py_plus(self, a: list, b: list) -> list:
        return self._best(self._set(a) | self._set(b))

    def py_sum(self, values: list) -> list:
        """All at once: the best of a union are the best of its parts' best, and ranking every partial sum takes the square of a group's size."""
        return self._best(set().union(*map(self._set, values)))

    def py_times(self, a: list, b: list) -> list:
        return self._best({c for x, y in itertools.product(self._set(a), self._set(b)) if (c := self._joined(x, y)) is not None})

    def py_negate(self, a: list) -> list:
        out: list = [[]]
        for clause in self._set(a):
            out = self.py_times(out, [[(f, p, x, not neg)] for f, p, x, neg in clause])
        return out

    def saturated(self, old: Column, new: Column) -> Column:
        return F.udf(lambda a, b: a is not None and b is not None and self._set(a) == self._set(b), "boolean")(old, new)

    def py_weight(self, a: list) -> float:
        return wmc(self._set(a))

    def recover(self, a: Column) -> Column:
        return F.udf(self.py_weight, "double")(a)


class ProofSets(Proofs):
    """All proofs, shown as sets of fact ids."""

    def recover(self, a: Column) -> Column:
        return F.udf(lambda t: sorted([sorted(x[0] for x in c) for c in t]), "array<array<bigint>>")(a)


class DiffProofs(Proofs):
    """Probabilities with their derivatives by the probability of each fact."""

    def recover(self, a: Column) -> Column:
        return F.udf(lambda tag: differentiated(self._set(tag)), "struct<p:double,gradient:map<bigint,double>>")(a)


class SampledProofs(Proofs):
    """Keeps ``k`` proofs, drawn by their probability with a seeded generator."""

    def __init__(self, k: int | None = None, name: str = "proofs") -> None:
        super().__init__(k, name)
        self.parts = 1  # a draw is from a whole group

    def py_sum(self, values: list) -> list:
        return UdfAlgebra.py_sum(self, values)  # a draw follows each sum

    def _best(self, clauses: set) -> list:
        import random

        ordered = sorted(clauses, key=str)
        rng = random.Random(str(ordered))
        while self.k is not None and len(ordered) > self.k:
            weights = [1 - self._chance(c) + 1e-9 for c in ordered]
            ordered.remove(rng.choices(ordered, weights)[0])
        return [list(c) for c in ordered]


def differentiated(clauses: set) -> tuple[float, dict[int, float]]:
    """The probability of a disjunction and its derivatives by the probabilities of the facts."""
    facts = {x[0] for c in clauses for x in c}
    return wmc(clauses), {f: wmc(_given_fact(clauses, f, True)) - wmc(_given_fact(clauses, f, False)) for f in facts}


def _given_fact(clauses: set, fact: int, holds: bool) -> set:
    """The clauses after a fact is known to hold or not."""
    out = set()
    group = next((x[2] for c in clauses for x in c if x[0] == fact), None)
    for c in clauses:
        rest, ok = [], True
        for x in c:
            if x[0] == fact:
                ok = ok and x[3] != holds
            elif holds and group is not None and x[2] == group:
                ok = ok and x[3]  # another fact of the group can't hold
            else:
                rest.append(x)
        if ok:
            out.add(tuple(rest))
    return out


def _given_member(clauses: frozenset, group: int, members: dict[int, float]) -> tuple[Callable[[int], frozenset], frozenset]:
    """The clauses after one fact of an exclusive group is known to hold, by the fact, and after none holds.

    The clauses are sorted out once, so a group of many facts takes no more than one pass.
    """
    own: dict[int, set] = {}  # by the fact they need
    without: list[tuple[tuple, set]] = []  # need that some facts don't hold
    rest = set()
    for c in clauses:
        needs, bars = {x[0] for x in c if x[2] == group and not x[3]}, {x[0] for x in c if x[2] == group and x[3]}
        other = tuple(x for x in c if x[2] != group)
        if not needs and not bars:
            rest.add(c)
        elif not needs:
            without.append((other, bars))
        elif len(needs) == 1 and not needs & bars:
            own.setdefault(next(iter(needs)), set()).add(other)
    rest = frozenset(rest)

    def left(fact: int) -> frozenset:
        return rest.union(own.get(fact, ()), (c for c, bars in without if fact not in bars))

    return left, rest.union(c for c, _ in without)


def wmc(clauses: set) -> float:
    """The probability of a disjunction of clauses, by Shannon expansion over facts and exclusive groups."""
    memo: dict = {}

    def solve(now: frozenset) -> float:
        if not now:
            return 0.0
        if () in now:
            return 1.0
        if now in memo:
            return memo[now]
        first = min((x for c in now for x in c), key=lambda x: (x[2] is None, x[0]))
        total = 0.0
        if first[2] is None:
            p = first[1]
            total = p * solve(frozenset(_given_fact(now, first[0], True))) + (1 - p) * solve(frozenset(_given_fact(now, first[0], False)))
        else:  # one of the group's facts holds, or none
            members = {x[0]: x[1] for c in now for x in c if x[2] == first[2]}
            left, none = _given_member(now, first[2], members)
            for fact, p in members.items():
                total += p * solve(left(fact))
            total += max(0.0, 1 - sum(members.values())) * solve(none)
        memo[now] = total
        return total

    return solve(frozenset(clauses))


class TopBottomClauses(UdfAlgebra):
    """The k most probable proofs of a formula or, for negated formulas, of its negation.

    A negated formula is a conjunction of clauses, each the negation of a proof; keeping the k most probable proofs of the
    negation keeps the k least probable clauses. So negating loses nothing, and conjunctions of negated formulas are
    unions. Mixed operations turn the negated side into proofs first.
    """

    type = f"struct<negated:boolean,proofs:{Proofs.type}>"
    proofs = True

    def __init__(self, k: int | None, name: str = "topbottomkclauses") -> None:
        self.k, self.name, self.inner = k, name, Proofs(k)
        self.parts = 1 if k is None else 64

    def py_one(self) -> tuple:
        return False, self.inner.py_one()

    def py_zero(self) -> tuple:
        return False, self.inner.py_zero()

    def py_given(self, prob: float | None, fact: int, group: int | None) -> tuple:
        return False, self.inner.py_given(prob, fact, group)

    def _positive(self, a: Any) -> list:
        return self.inner.py_negate(a[1]) if a[0] else a[1]

    def py_plus(self, a: Any, b: Any) -> tuple:
        if a[0] and b[0]:  # not (x and y)
            return True, self.inner.py_times(a[1], b[1])
        return False, self.inner.py_plus(self._positive(a), self._positive(b))

    def py_times(self, a: Any, b: Any) -> tuple:
        if a[0] and b[0]:  # not (x or y)
            return True, self.inner.py_plus(a[1], b[1])
        return False, self.inner.py_times(self._positive(a), self._positive(b))

    def py_negate(self, a: Any) -> tuple:
        return not a[0], a[1]

    def saturated(self, old: Column, new: Column) -> Column:
        same = lambda a, b: a is not None and b is not None and a[0] == b[0] and Proofs._set(a[1]) == Proofs._set(b[1])
        return F.udf(same, "boolean")(old, new)

    def py_weight(self, a: Any) -> float:
        p = self.inner.py_weight(a[1])
        return 1 - p if a[0] else p

    def recover(self, a: Column) -> Column:
        return F.udf(self.py_weight, "double")(a)


class DiffTopBottomClauses(TopBottomClauses):
    """The same, shown with derivatives."""

    def recover(self, a: Column) -> Column:
        def both(tag: Any) -> tuple:
            p, gradient = differentiated(Proofs._set(tag[1]))
            return (1 - p, {f: -d for f, d in gradient.items()}) if tag[0] else (p, gradient)

        return F.udf(both, "struct<p:double,gradient:map<bigint,double>>")(a)


class DualNumbers(Algebra):
    """Probabilities with derivatives, combined by a scalar algebra's rules; all in the JVM."""

    type, tagged = "struct<p:double,gradient:map<bigint,double>>", True

    def __init__(self, scalar: Algebra) -> None:
        self.scalar, self.name, self.again = scalar, "diff" + scalar.name, scalar.again

    @staticmethod
    def _dual(p: Column, gradient: Column) -> Column:
        return F.struct(p.alias("p"), gradient.alias("gradient"))

    @staticmethod
    def _none() -> Column:
        return F.create_map().cast("map<bigint,double>")

    def one(self) -> Column:
        return self._dual(F.lit(1.0), self._none())

    def zero(self) -> Column:
        return self._dual(F.lit(0.0), self._none())

    def given(self, prob: Column, fact: Column, group: Column) -> Column:
        known = self._dual(prob.cast("double"), F.create_map(fact.cast("bigint"), F.lit(1.0)))
        return F.when(prob.isNull(), self.one()).otherwise(known)

    @staticmethod
    def _mixed(a: Column, b: Column, da: Column, db: Column) -> Column:
        """The gradient of a function of a and b with these derivatives."""
        zero = F.lit(0.0)
        return F.map_zip_with(a["gradient"], b["gradient"], lambda _, x, y: da * F.coalesce(x, zero) + db * F.coalesce(y, zero))

    def plus(self, a: Column, b: Column) -> Column:
        kind, one = type(self.scalar), F.lit(1.0)
        if kind is AddMultProb:
            return self._dual(F.least(one, a["p"] + b["p"]), self._mixed(a, b, one, one))
        if kind in (NandMultProb, NandMinProb):
            return self._dual(1 - (1 - a["p"]) * (1 - b["p"]), self._mixed(a, b, 1 - b["p"], 1 - a["p"]))
        return F.when(a["p"] >= b["p"], a).otherwise(b)

    def times(self, a: Column, b: Column) -> Column:
        if type(self.scalar) in (MinMaxProb, NandMinProb):
            return F.when(a["p"] <= b["p"], a).otherwise(b)
        return self._dual(a["p"] * b["p"], self._mixed(a, b, b["p"], a["p"]))

    def sum(self, tags: Column) -> Column:
        if type(self.scalar) in (MinMaxProb, MaxMultProb):
            return F.max_by(tags, tags["p"])
        return F.aggregate(F.collect_list(tags), self.zero(), self.plus)

    def negate(self, a: Column) -> Column:
        return self._dual(1 - a["p"], F.transform_values(a["gradient"], lambda _, v: -v))

    def saturated(self, old: Column, new: Column) -> Column:
        return F.abs(old["p"] - new["p"]) < 1e-12

    def weight(self, a: Column) -> Column:
        return a["p"]

    # the same on Python values, for aggregates over all worlds

    def py_one(self) -> tuple:
        return 1.0, {}

    def py_zero(self) -> tuple:
        return 0.0, {}

    @staticmethod
    def _py_mixed(a: Any, b: Any, da: float, db: float) -> dict:
        out = {k: da * v for k, v in (a[1] or {}).items()}
        for k, v in (b[1] or {}).items():
            out[k] = out.get(k, 0.0) + db * v
        return out

    def py_plus(self, a: Any, b: Any) -> tuple:
        kind = type(self.scalar)
        if kind is AddMultProb:
            return min(1.0, a[0] + b[0]), self._py_mixed(a, b, 1.0, 1.0)
        if kind in (NandMultProb, NandMinProb):
            return 1 - (1 - a[0]) * (1 - b[0]), self._py_mixed(a, b, 1 - b[0], 1 - a[0])
        return (a[0], a[1]) if a[0] >= b[0] else (b[0], b[1])

    def py_times(self, a: Any, b: Any) -> tuple:
        if type(self.scalar) in (MinMaxProb, NandMinProb):
            return (a[0], a[1]) if a[0] <= b[0] else (b[0], b[1])
        return a[0] * b[0], self._py_mixed(a, b, b[0], a[0])

    def py_negate(self, a: Any) -> tuple:
        return 1 - a[0], {k: -v for k, v in (a[1] or {}).items()}

    def py_weight(self, a: Any) -> float:
        return a[0]


class Pair(UdfAlgebra):
    """Two algebras side by side."""

    def __init__(self, first: Algebra, second: Algebra) -> None:
        self.first, self.second = first, second
        self.name, self.again = f"{first.name}*{second.name}", first.again and second.again
        self.type = f"struct<a:{first.type},b:{second.type}>"

    def one(self) -> Column:
        return F.struct(self.first.one().alias("a"), self.second.one().alias("b"))

    def given(self, prob: Column, fact: Column, group: Column) -> Column:
        return F.struct(self.first.given(prob, fact, group).alias("a"), self.second.given(prob, fact, group).alias("b"))

    def times(self, a: Column, b: Column) -> Column:
        return F.struct(self.first.times(a["a"], b["a"]).alias("a"), self.second.times(a["b"], b["b"]).alias("b"))

    def plus(self, a: Column, b: Column) -> Column:
        return F.struct(self.first.plus(a["a"], b["a"]).alias("a"), self.second.plus(a["b"], b["b"]).alias("b"))

    def sum(self, tags: Column) -> Column:
        return F.struct(self.first.sum(tags["a"]).alias("a"), self.second.sum(tags["b"]).alias("b"))

    def negate(self, a: Column) -> Column | None:
        one, two = self.first.negate(a["a"]), self.second.negate(a["b"])
        return None if one is None or two is None else F.struct(one.alias("a"), two.alias("b"))

    def saturated(self, old: Column, new: Column) -> Column:
        return self.first.saturated(old["a"], new["a"]) & self.second.saturated(old["b"], new["b"])

    def weight(self, a: Column) -> Column:
        return self.first.weight(a["a"])

    def recover(self, a: Column) -> Column:
        return F.struct(self.first.recover(a["a"]).alias("a"), self.second.recover(a["b"]).alias("b"))


def algebra(name: str | Algebra, k: int = 3) -> Algebra:
    """The algebra of a name."""
    if isinstance(name, Algebra):
        return name
    scalar = {c.name: c for c in (Boolean, Natural, Tropical, RealTropical, MinMaxProb, AddMultProb, MaxMultProb, NandMultProb, NandMinProb)}
    if name in scalar:
        return scalar[name]()
    made = {
        "unit": lambda: Algebra(),
        "proofs": lambda: ProofSets(None, "proofs"),
        "probproofs": lambda: Proofs(None, "probproofs"),
        "realtropicalproofs": lambda: Proofs(1, "realtropicalproofs"),
        "topkproofs": lambda: Proofs(k, "topkproofs"),
        "topbottomkclauses": lambda: TopBottomClauses(k),
        "samplekproofs": lambda: SampledProofs(k, "samplekproofs"),
        "difftopkproofs": lambda: DiffProofs(k, "difftopkproofs"),
        "difftopkproofsdebug": lambda: DiffProofs(k, "difftopkproofsdebug"),
        "difftopbottomkclauses": lambda: DiffTopBottomClauses(k, "difftopbottomkclauses"),
        "diffsamplekproofs": lambda: DiffProofs(k, "diffsamplekproofs"),
        "diffminmaxprob": lambda: DualNumbers(MinMaxProb()),
        "diffaddmultprob": lambda: DualNumbers(AddMultProb()),
        "diffmaxmultprob": lambda: DualNumbers(MaxMultProb()),
        "diffnandmultprob": lambda: DualNumbers(NandMultProb()),
        "diffnandminprob": lambda: DualNumbers(NandMinProb()),
    }
    key = name.replace("-", "").replace("_", "")
    if key not in made:
        raise ValueError(f"no algebra {name!r}")
    return made[key]()
