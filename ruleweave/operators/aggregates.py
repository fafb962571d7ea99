"""Aggregates over relations with tags.

Input: a DataFrame of group, argument and value columns (and a tag column), already reduced to distinct rows. Without
tags (or with !) aggregates are plain SQL aggregates and windows. With tags, count, sum, prod, avg, min, max, exists and
string_join have a result for every possible world. With plain probabilities, exists, min and max are closed forms over
grouped aggregates and running products, and count is dynamic programming over arrays, all in the JVM. Other tags, and sum, prod,
avg and string_join, use dynamic programming over the partial results in Python: the work grows with the number of different
partial results, not with the number of worlds.

Groups are gathered in one row only where the result needs them whole: string_join, count over worlds, and what runs in Python.
min, max, top and unique are rank windows, of which Spark keeps only the first ranks of each partition before it shuffles.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import ProgramError
from ..types import INTEGERS, SPARK
from .tags import TAG, Algebra, MaxMultProb

#: Aggregates that keep each row's own tag.
KEEPING = {"enumerate", "rank", "sort", "argsort", "top", "unique", "categorical", "uniform", "normalize", "softmax", "disjunct"}
#: The parameters that each aggregate takes, in order.
PARAMETERS = {
    "string_join": ("sep", "all"),
    "sort": ("desc", "asc"),
    "argsort": ("desc", "asc"),
    "rank": ("desc", "asc"),
    "top": ("k",),
    "categorical": ("k",),
    "uniform": ("k",),
}
NAMES = {"count", "sum", "prod", "avg", "weighted_sum", "weighted_avg", "min", "max", "argmin", "argmax", "exists", "forall", "string_join"} | KEEPING


@dataclass
class Spec:
    """What to compute: the aggregate, its parameters, and the columns it reads."""

    op: str
    params: dict[str, Any]
    groups: list[str]
    args: list[str]
    values: list[str]
    value_types: list[str]
    arg_types: list[str]
    hard: bool = False
    seed: int = 1234


def parameters(op: str, given: tuple) -> dict[str, Any]:
    """Positional and named parameters by name."""
    names = PARAMETERS.get(op, ())
    places = [v for n, v in given if n is None]
    if len(places) > (1 if names else 0):
        raise ProgramError(f"{op}: too many parameters ({len(places)})")
    out = dict(zip(names, places, strict=False))
    for name, value in given:
        if name is not None:
            if name not in names:
                raise ProgramError(f"{op} has no parameter named {name}")
            out[name] = value
    return out


def output_types(spec: Spec) -> list[str]:
    """The types of the columns that an aggregate gives."""
    op = spec.op
    if op in ("argmin", "argmax") and not spec.args:
        raise ProgramError(f"{op} needs variables in brackets, whose values it gives")
    return {
        "count": ["usize"],
        "sum": spec.value_types[:1],
        "prod": spec.value_types[:1],
        "avg": spec.value_types[:1],
        "weighted_sum": spec.value_types[:1],
        "weighted_avg": spec.value_types[:1],
        "exists": ["bool"],
        "string_join": ["String"],
        "min": spec.arg_types + spec.value_types,
        "max": spec.arg_types + spec.value_types,
        "argmin": spec.arg_types,
        "argmax": spec.arg_types,
        "enumerate": ["usize", *spec.value_types],
        "rank": ["usize", *spec.value_types],
        "sort": ["usize", *spec.arg_types, *spec.value_types],
        "argsort": ["usize", *spec.arg_types],
    }.get(op, spec.arg_types + spec.value_types)


def aggregate(rows: DataFrame, spec: Spec, algebra: Algebra, domain: DataFrame | None = None) -> DataFrame:
    """Groups, then output columns o0, o1, ..., and the tag if there is one. ``domain``: the groups of a where clause."""
    soft = algebra.type is not None and not spec.hard
    if spec.op in KEEPING:
        out = _keeping(rows, spec, algebra)
    elif soft:
        out = _counted_worlds(rows, spec, algebra) if algebra.plain and spec.op in ("exists", "min", "max", "argmin", "argmax", "count") else _worlds(rows, spec, algebra)
    else:
        out = _plain(rows, spec, algebra)
    return _with_empty(out, spec, algebra, domain, soft)


def _with_empty(out: DataFrame, spec: Spec, algebra: Algebra, domain: DataFrame | None, soft: bool) -> DataFrame:
    """Groups of a where clause get the value of the empty aggregate, with their own tags on top."""
    if domain is None:
        return out
    empty = {"count": 0, "sum": 0, "prod": 1, "exists": False}.get(spec.op)
    marked = domain.withColumnRenamed(TAG, "__group_tag") if algebra.type else domain
    joined = marked.join(out.withColumn("__found", F.lit(True)), spec.groups, "inner" if empty is None else "left") if spec.groups else marked.crossJoin(out)
    if empty is not None:
        joined = joined.withColumn("o0", F.coalesce("o0", F.lit(empty).cast(SPARK[output_types(spec)[0]])))
    if algebra.type:
        joined = joined.withColumn(TAG, algebra.times(F.col("__group_tag"), F.coalesce(F.col(TAG), algebra.one()))).drop("__group_tag")
    return joined.drop("__found")


def _order(names: list[str], descending: bool = False) -> list[Column]:
    return [F.desc(n) if descending else F.asc(n) for n in names]


def _keeping(rows: DataFrame, spec: Spec, algebra: Algebra) -> DataFrame:
    op, by, columns = spec.op, spec.groups, [*spec.args, *spec.values]
    weight = algebra.weight(F.col(TAG)) if algebra.type else F.lit(1.0)
    tags = [TAG] if algebra.type else []

    def picked(number: Column | None, names: list[str]) -> DataFrame:
        out = rows if number is None else rows.withColumn("__i", number)
        first = [] if number is None else [F.col("__i").cast("bigint")]
        return out.select(*by, *[c.alias(f"o{k}") for k, c in enumerate([*first, *map(F.col, names)])], *tags)

    if op in ("normalize", "softmax"):
        if algebra.type != "double":
            return picked(None, columns)
        scaled = F.exp(weight) if op == "softmax" else weight
        total = F.sum(scaled).over(Window.partitionBy(*by))
        rows = rows.withColumn(TAG, F.when(total != 0, scaled / total).otherwise(F.lit(0.0)))
        return picked(None, columns)
    if op == "disjunct":
        if not algebra.proofs:
            return picked(None, columns)
        group = F.xxhash64(F.lit("disjunct"), *by, *spec.args)
        own = F.xxhash64(F.lit("disjunct"), *by, *columns)
        rows = rows.withColumn(TAG, algebra.times(F.col(TAG), algebra.given(F.lit(1.0), own, group)))
        return picked(None, columns)
    if op == "enumerate":
        return picked(F.row_number().over(Window.partitionBy(*by).orderBy(*_order(columns))) - 1, columns)
    if op == "rank":
        descending = spec.params.get("desc", not spec.params.get("asc", False))
        key = weight.desc() if descending else weight.asc()
        return picked(F.row_number().over(Window.partitionBy(*by).orderBy(key, *_order(columns))) - 1, columns)
    if op in ("sort", "argsort"):
        descending = spec.params.get("desc", not spec.params.get("asc", False))
        window = Window.partitionBy(*by).orderBy(*_order(spec.values, descending), *_order(spec.args))
        return picked(F.row_number().over(window) - 1, columns if op == "sort" else spec.args)
    k = 1 if op == "unique" else int(spec.params.get("k", 1))
    if op in ("top", "unique"):
        window = Window.partitionBy(*by).orderBy(weight.desc(), *_order(columns))
        rows = rows.withColumn("__r", F.row_number().over(window)).where(F.col("__r") <= k)
        return picked(None, columns)
    # samples with replacement, equal draws merged: k seeded draws, each the row of the least key
    share = F.when(weight > 0, weight) if op == "categorical" else F.lit(1.0)
    draws = rows.withColumn("__n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draws = draws.withColumn("__key", -F.ln((F.pmod(F.xxhash64(F.col("__n") + F.lit(spec.seed), *columns), F.lit(2**31)) + 1) / float(2**31 + 1)) / share)
    window = Window.partitionBy(*by, "__n").orderBy(F.asc_nulls_last("__key"), *_order(columns))
    rows = draws.withColumn("__r", F.row_number().over(window)).where("__r = 1").drop("__r", "__n", "__key").dropDuplicates([*by, *columns])
    return picked(None, columns)


def _plain(rows: DataFrame, spec: Spec, algebra: Algebra) -> DataFrame:
    """Aggregates that ignore tags; the result's tag is one."""
    op, by = spec.op, spec.groups
    kind = output_types(spec)
    value = F.col(spec.values[0]) if spec.values else None
    weight = algebra.weight(F.col(TAG)) if algebra.type else F.lit(1.0)
    if op in ("min", "max", "argmin", "argmax"):
        window = Window.partitionBy(*by).orderBy(*_order(spec.values, "max" in op))
        best = rows.withColumn("__r", F.rank().over(window)).where("__r = 1")
        names = spec.args if op.startswith("arg") else [*spec.args, *spec.values]
        out = best.select(*by, *[F.col(n).alias(f"o{k}") for k, n in enumerate(names)]).distinct()
    else:
        n = F.count(F.lit(1))
        empty: Any = None
        if op == "count":
            made, empty = n, 0
        elif op == "exists":
            made, empty = n > 0, False
        elif op == "sum":
            made, empty = F.sum(value), 0
        elif op == "prod":
            made, empty = F.product(value), 1
        elif op == "avg":
            made = F.call_function("div", F.sum(value).cast("bigint"), n) if kind[0] in INTEGERS else F.avg(value)
        elif op == "weighted_sum":
            made = F.sum(weight * value)
        elif op == "weighted_avg":
            made = F.sum(weight * value) / F.sum(weight)
        elif op == "string_join":
            made = _joined(spec)
        else:
            raise ProgramError(f"no aggregate {op!r}")
        if empty is not None and not by:
            made = F.coalesce(made, F.lit(empty))
        out = rows.groupBy(*by).agg(made.cast(SPARK[kind[0]]).alias("o0")).where("o0 is not null")
    return out.withColumn(TAG, algebra.one()) if algebra.type else out


def _joined(spec: Spec) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(*spec.args, *spec.values)))
    return F.when(F.count(F.lit(1)) >= 0, F.array_join(F.transform(ordered, lambda x: x[spec.values[0]].cast("string")), spec.params.get("sep", "")))


def _counted_worlds(rows: DataFrame, spec: Spec, algebra: Algebra) -> DataFrame:
    """exists, count and extremes in all worlds, for tags that are plain numbers."""
    op, by, tag = spec.op, spec.groups, F.col(TAG)
    if op == "exists":
        total = F.coalesce(algebra.sum(tag), algebra.zero())
        whole = rows.groupBy(*by).agg(total.alias("__total"))
        both = F.array(F.struct(F.lit(True).alias("o0"), F.col("__total").alias(TAG)), F.struct(F.lit(False).alias("o0"), algebra.negate(F.col("__total")).alias(TAG)))
        return whole.select(*by, F.explode(both).alias("__o")).select(*by, "__o.*")
    if op == "count":
        # tags of 0, 1, ... rows: each row moves every number up by one, or leaves it
        def step(known: Column, t: Column) -> Column:
            stays = F.concat(F.transform(known, lambda w: algebra.times(w, algebra.negate(t))), F.array(algebra.zero()))
            grows = F.concat(F.array(algebra.zero()), F.transform(known, lambda w: algebra.times(w, t)))
            return F.zip_with(stays, grows, algebra.plus)

        numbers = rows.groupBy(*by).agg(F.aggregate(F.collect_list(tag), F.array(algebra.one()), step).alias("__n"))
        return numbers.select(*by, F.posexplode("__n").alias("o0", TAG)).withColumn("o0", F.col("o0").cast("bigint"))
    # an extreme holds where its row does and no better value does
    inverse = algebra.negate(tag)
    none = F.product(inverse) if type(algebra).times is MaxMultProb.times else F.min(inverse)
    values = rows.groupBy(*by, *spec.values).agg(none.alias("__none"))
    window = Window.partitionBy(*by).orderBy(*_order(spec.values, "max" in op)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.product("__none") if type(algebra).times is MaxMultProb.times else F.min("__none")
    values = values.withColumn("__before", F.coalesce(before.over(window), algebra.one())).drop("__none")
    names = spec.args if op.startswith("arg") else [*spec.args, *spec.values]
    found = rows.join(values, [*by, *spec.values]).select(*by, *[F.col(n).alias(f"o{k}") for k, n in enumerate(names)], algebra.times(F.col("__before"), tag).alias(TAG))
    return found.groupBy(*by, *[f"o{k}" for k in range(len(names))]).agg(algebra.sum(tag).alias(TAG))


def _worlds(rows: DataFrame, spec: Spec, algebra: Algebra) -> DataFrame:
    """The results in all worlds, per group, in Python."""
    kinds = output_types(spec)
    plus, times, negate, one, zero = algebra.py_plus, algebra.py_times, algebra.py_negate, algebra.py_one, algebra.py_zero
    op, params = spec.op, spec.params
    start, step, end = _folds(op, params, kinds)
    columns = [*spec.args, *spec.values]
    n_args = len(spec.args)

    def solve(facts: list[tuple[tuple, Any]]) -> dict[tuple, Any]:
        facts = sorted(facts, key=lambda f: f[0])
        out: dict[tuple, Any] = {}

        def add(into: dict, key: Any, tag: Any) -> None:
            if tag is not None:
                into[key] = plus(into[key], tag) if key in into else tag

        if op == "exists":
            total = zero()
            for _, t in facts:
                total = plus(total, t)
            add(out, (True,), total)
            add(out, (False,), negate(total) if facts else one())
            return out
        if op in ("min", "max", "argmin", "argmax"):
            order = sorted({f[0][n_args:] for f in facts}, reverse="max" in op)
            before = one()
            for value in order:
                tied = [f for f in facts if f[0][n_args:] == value]
                for key, t in tied:
                    if before is not None:
                        add(out, key[:n_args] if op.startswith("arg") else key, times(before, t))
                for _, t in tied:
                    inverse = negate(t)
                    before = None if inverse is None or before is None else times(before, inverse)
            return out
        if op == "string_join" and params.get("all"):
            by_arg: dict[tuple, list] = {}
            for key, t in facts:
                by_arg.setdefault(key[:n_args], []).append((key, t))
            for chosen in itertools.product(*[by_arg[a] for a in sorted(by_arg)]):
                tag, value = one(), start
                for key, t in chosen:
                    tag, value = times(tag, t), step(value, key[-1])
                add(out, (end(value),), tag)
            return out
        found: dict[Any, Any] = {start: one()}
        for key, t in facts:
            inverse, grown = negate(t), {}
            for value, w in found.items():
                add(grown, step(value, key[-1]), times(w, t))
                if inverse is not None:
                    add(grown, value, times(w, inverse))
            found = grown
        for value, w in found.items():
            if end(value) is not None:
                add(out, (end(value),), w)
        return out

    fields = [T.StructField(f"o{k}", SPARK[t]) for k, t in enumerate(kinds)]
    tag_type = T._parse_datatype_string(algebra.type)
    result = T.ArrayType(T.StructType([*fields, T.StructField(TAG, tag_type)]))

    def run(group: list) -> list[tuple]:
        found = solve([(tuple(r[c] for c in columns), r[TAG]) for r in group])
        return [(*key, tag) for key, tag in found.items()]

    packed = rows.groupBy(*spec.groups).agg(F.collect_list(F.struct(*columns, TAG)).alias("__rows"))
    made = packed.select(*spec.groups, F.explode(F.udf(run, result)("__rows")).alias("__o"))
    return made.select(*spec.groups, "__o.*")


def _folds(op: str, params: dict[str, Any], kinds: list[str]) -> tuple[Any, Callable, Callable]:
    """An aggregate as a partial result to start from, its step by a value, and the result of a partial result."""
    whole = kinds[0] in INTEGERS
    if op == "count":
        return 0, lambda n, _: n + 1, lambda n: n
    if op in ("sum", "weighted_sum"):
        return 0 if whole else 0.0, lambda s, v: s + v, lambda s: s
    if op == "prod":
        return 1 if whole else 1.0, lambda s, v: s * v, lambda s: s
    if op in ("avg", "weighted_avg"):
        return (0, 0), lambda s, v: (s[0] + 1, s[1] + v), lambda s: None if not s[0] else int(s[1] / s[0]) if whole else s[1] / s[0]
    separator = str(params.get("sep", ""))
    return None, lambda s, v: str(v) if s is None else s + separator + str(v), lambda s: "" if s is None else s
