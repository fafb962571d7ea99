"""Bodies of rules as DataFrame plans.

A body becomes a table of its variables (columns ``v_...``) and a tag. Literals are taken in an order in which atoms join on
variables that are bound already; checks filter, or bind a variable, as soon as they can; negation and
foreign predicates follow when their arguments are bound. Everything is lazy; Catalyst picks the physical plan.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import FUNCTIONS, Typed, TypeProblem, binary, cast, entity, unary
from ..functions.table import PREDICATES, Predicate
from ..operators.aggregates import NAMES, Spec, aggregate, output_types, parameters
from ..operators.tags import TAG, Algebra
from ..storage import written
from ..types import FLOATS, INTEGERS, NUMBERS, SPARK
from .normal import Aggregate, Exists, FlatRule, solve, variables
from .syntax import Atom, Binary, Call, Cast, Check, Const, IfElse, Not, ProgramError, Unary, Var, Wild

_ORDER = ["i8", "u8", "i16", "u16", "i32", "u32", "i64", "isize", "usize", "u64", "i128", "u128", "f32", "f64"]
#: Where a function's result has not the type of its first argument.
_RESULTS = {"string_length": "usize", "string_index_of": "usize", "string_char_at": "char", "hash": "u64", "datetime_day": "u32", "datetime_month": "u32", "datetime_month0": "u32", "datetime_year": "i32", "dim": "usize", "dot": "f64", "format": "String", "substring": "String", "string_concat": "String", "#entity": "Entity", "parse_entity": "Entity"}


@dataclass
class Table:
    """A table of variables."""

    df: DataFrame | None = None
    types: dict[str, str] = field(default_factory=dict)


def column_of(name: str) -> str:
    return "v_" + name.replace("#", "0")


def parse_duration(text: str) -> tuple[int, int]:
    """(months, microseconds) of texts like ``1y2M3d`` or ``5 minutes``."""
    months = {"y": 12, "year": 12, "years": 12, "M": 1, "mo": 1, "month": 1, "months": 1}
    micros = {"w": 604800, "week": 604800, "d": 86400, "day": 86400, "h": 3600, "hr": 3600, "hour": 3600, "m": 60, "min": 60, "minute": 60, "s": 1, "sec": 1, "second": 1}
    total = [0, 0.0]
    found = re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z]+)", text)
    if not found:
        raise ProgramError(f"no duration: {text!r}")
    for n, unit in found:
        if unit in months:
            total[0] += int(float(n) * months[unit])
        elif unit in micros or unit.rstrip("s") in micros:
            total[1] += float(n) * micros.get(unit, micros.get(unit.rstrip("s"), 0)) * 1e6
        elif unit in ("ms", "us", "ns"):
            total[1] += float(n) * {"ms": 1e3, "us": 1.0, "ns": 1e-3}[unit]
        else:
            raise ProgramError(f"unknown unit {unit!r}")
    return int(total[0]), int(total[1])


def parse_datetime(text: str) -> dt.datetime:
    import pandas as pd

    found = pd.to_datetime(text, utc=True)
    return found.to_pydatetime()


def python_value(value: Any, kind: str) -> Any:
    """A constant as createDataFrame wants it."""
    if kind == "DateTime" and isinstance(value, str):
        return parse_datetime(value)
    if kind == "Duration" and isinstance(value, str):
        return parse_duration(value)
    if kind in FLOATS and not isinstance(value, bool):
        return float(value)
    if kind in INTEGERS:
        if SPARK[kind].typeName().startswith("decimal"):
            import decimal

            return decimal.Decimal(int(value))
        return int(value)
    return value


def literal(value: Any, kind: str) -> Column:
    if kind == "Duration":
        months, micros = parse_duration(value)
        return F.struct(F.lit(months).alias("months"), F.lit(micros).cast("bigint").alias("micros"))
    if kind == "DateTime":
        return F.timestamp_micros(F.lit(int(parse_datetime(value).timestamp() * 1_000_000)))
    if kind in INTEGERS and abs(value) >= 2**63:
        return F.lit(str(value)).cast(SPARK[kind])
    return F.lit(value).cast(SPARK[kind])


class Evaluator:
    """Turns bodies into tables, for one algebra and set of functions."""

    def __init__(self, spark: SparkSession, algebra: Algebra, functions: dict | None = None, predicates: dict[str, Predicate] | None = None, aggregates: dict | None = None, broadcasts: set | None = None, aliases: Callable[[str], str] | None = None) -> None:
        self.spark, self.algebra = spark, algebra
        self.functions = FUNCTIONS | (functions or {})
        self.predicates = PREDICATES | (predicates or {})
        self.aggregates, self.broadcasts = aggregates or {}, broadcasts or set()
        self.type_name = aliases or (lambda t: t)

    # types ahead of evaluation; int? and float? are literals that take any fitting type

    def type_of(self, x: Any, known: dict[str, str]) -> str | None:
        if isinstance(x, Const):
            return {"int": "int?", "float": "float?", "str": "String", "symbol": "Symbol", "char": "char", "bool": "bool", "datetime": "DateTime", "duration": "Duration"}[x.kind]
        if isinstance(x, Var):
            return known.get(x.name)
        if isinstance(x, Cast):
            return self.type_name(x.type)
        if isinstance(x, Unary):
            return "bool" if x.op == "!" else self.type_of(x.of, known)
        if isinstance(x, IfElse):
            return self.merged(self.type_of(x.then, known), self.type_of(x.other, known))
        if isinstance(x, Binary):
            if x.op in ("==", "!=", "<", "<=", ">", ">=", "&&", "||", "^"):
                return "bool"
            a, b = self.type_of(x.left, known), self.type_of(x.right, known)
            if a == b == "DateTime":
                return "Duration"
            if "DateTime" in (a, b):
                return "DateTime"
            if "Duration" in (a, b):
                return "Duration"
            return self.merged(a, b)
        if isinstance(x, Call):
            if x.name == "sign" and x.args:
                a = self.type_of(x.args[0], known)
                return "i32" if a in FLOATS or a == "float?" else a
            if x.name in _RESULTS:
                return _RESULTS[x.name]
            if x.name in self.functions and hasattr(self.functions[x.name], "result"):
                return self.functions[x.name].result
            out = None
            for a in x.args[: 1 if not x.name.startswith(("max", "min")) else None]:
                out = self.merged(out, self.type_of(a, known))
            return out
        return None

    @staticmethod
    def merged(a: str | None, b: str | None) -> str | None:
        """The type of two that must agree; literals give way."""
        if a is None or b is None or a == b:
            return a or b
        for weak, strong in ((a, b), (b, a)):
            if weak == "int?" and (strong in NUMBERS or strong == "float?"):
                return strong
            if weak == "float?" and strong in FLOATS:
                return strong
        if a in INTEGERS and b in INTEGERS or a in FLOATS and b in FLOATS:
            return max(a, b, key=_ORDER.index)
        return a

    def body_types(self, body: tuple, columns: Callable[[str], list], head: set[str]) -> dict[str, str]:
        """The types of a body's variables, as far as they are known."""
        known: dict[str, str] = {}
        for _ in range(len(body) + 1):
            before = dict(known)
            for x in body:
                if isinstance(x, Atom):
                    kinds = columns(x.pred)
                    if kinds is None and x.pred in self.predicates:
                        p = self.predicates[x.pred]
                        kinds = [None] * p.bound + [(self.type_of(x.args[int(f[1:])], known) if f[0] == "=" else f) for f in p.free]
                        if x.types:
                            kinds = [self.type_name(x.types[0])] * len(x.args)
                    for a, t in zip(x.args, kinds or [], strict=False):
                        if isinstance(a, Var) and t is not None:
                            known[a.name] = self.merged(known.get(a.name), t)
                elif isinstance(x, Check) and isinstance(x.expr, Binary) and x.expr.op == "==":
                    free = [v for v in sorted(variables(x.expr)) if v not in known or known[v].endswith("?")]
                    for v in free:
                        made = solve(x.expr.left, x.expr.right, v)
                        t = self.type_of(made, known) if made is not None else None
                        if t is not None:
                            known[v] = self.merged(known.get(v), t)
                elif isinstance(x, Exists) and x.where:
                    for b in x.where:
                        known |= {v: t for v, t in self.body_types(b, columns, head).items() if v in {g.name for g in x.groups} and t}
                elif isinstance(x, Aggregate):
                    known |= {v: t for v, t in self.aggregate_types(x, columns, head).items() if t}
            if known == before:
                break
        return known

    def aggregate_types(self, x: Aggregate, columns: Callable[[str], list], head: set[str]) -> dict[str, str]:
        inner: dict[str, str] = {}
        for b in (*x.bodies, *x.where):
            for v, t in self.body_types(b, columns, head).items():
                inner[v] = self.merged(inner.get(v), t)
        r = x.reduce
        self.check_aggregate(r.op)
        spec = Spec(r.op, parameters(r.op, r.params) if r.op in NAMES else {}, [], [a.name for a in r.args], [b.name for b in r.bindings], [inner.get(b.name) for b in r.bindings], [inner.get(a.name) for a in r.args])
        kinds = [self.aggregates[r.op][1]] if r.op in self.aggregates else output_types(spec)
        return inner | dict(zip([o.name for o in r.outs], kinds, strict=False))

    def check_aggregate(self, op: str) -> None:
        if op not in NAMES and op not in self.aggregates:
            raise ProgramError(f"unknown aggregate {op!r}")

    # expressions

    def expr(self, x: Any, types: dict[str, str], want: str | None = None) -> Typed:
        if isinstance(x, Const):
            kind = {"int": "i32", "float": "f32", "char": "char", "str": "String", "symbol": "Symbol", "bool": "bool", "datetime": "DateTime", "duration": "Duration"}[x.kind]
            if x.kind == "int" and want in NUMBERS | {"Entity"} or x.kind == "float" and want in FLOATS or x.kind in ("str", "char") and want in ("String", "Symbol"):
                kind = want
            return literal(x.value, kind), kind
        if isinstance(x, Var):
            if x.name not in types:
                raise ProgramError(f"variable {x.name} is not bound")
            return F.col(column_of(x.name)), types[x.name]
        if isinstance(x, Cast):
            kind = self.type_name(x.type)
            if isinstance(x.of, Const) and x.of.kind in ("int", "float") and kind in NUMBERS | {"Entity"}:
                return literal(x.of.value, kind), kind
            return cast(self.expr(x.of, types), kind)
        if isinstance(x, Unary):
            return unary(x.op, self.expr(x.of, types, want))
        if isinstance(x, IfElse):
            kind = self._strong(self.merged(self.type_of(x.then, types), self.type_of(x.other, types)), want)
            then, other = self.expr(x.then, types, kind), self.expr(x.other, types, kind)
            return F.when(self.expr(x.test, types)[0], then[0]).otherwise(other[0]), then[1]
        if isinstance(x, Binary):
            arithmetic = x.op in ("+", "-", "*", "/", "%")
            ta, tb = self.type_of(x.left, types), self.type_of(x.right, types)
            kind = self.merged(ta, tb)
            if "Duration" in (ta, tb) and ta != tb:
                a, b = self.expr(x.left, types), self.expr(x.right, types)
            else:
                kind = self._strong(kind, want if arithmetic else None)
                a, b = self.expr(x.left, types, kind), self.expr(x.right, types, kind)
                a, b = self._together(a, b)
            return binary(x.op, a, b)
        if isinstance(x, Call):
            return self.call(x, types, want)
        if isinstance(x, Wild):
            raise ProgramError("a wildcard has no value")
        raise ProgramError(f"unexpected {x}")

    @staticmethod
    def _strong(kind: str | None, want: str | None) -> str | None:
        if kind in ("int?", "float?"):
            if want in FLOATS or want in INTEGERS and kind == "int?":
                return want
            return "i32" if kind == "int?" else "f32"
        return kind

    @staticmethod
    def _together(a: Typed, b: Typed) -> tuple[Typed, Typed]:
        """Integers of two sizes, or floats, meet in the larger."""
        if a[1] != b[1] and (a[1] in INTEGERS and b[1] in INTEGERS or a[1] in FLOATS and b[1] in FLOATS):
            kind = max(a[1], b[1], key=_ORDER.index)
            return (a[0].cast(SPARK[kind]), kind), (b[0].cast(SPARK[kind]), kind)
        return a, b

    def call(self, x: Call, types: dict[str, str], want: str | None) -> Typed:
        if x.name == "#entity":
            return entity(x.args[0].value, [self.expr(a, types)[0] for a in x.args[1:]]), "Entity"
        if x.name not in self.functions:
            raise ProgramError(f"unknown function ${x.name}")
        if x.name == "format":
            first = x.args[0]
            if not isinstance(first, Const):
                raise ProgramError("$format needs a constant pattern")
            return self.functions["format"]((first.value, "String"), *[self.expr(a, types) for a in x.args[1:]])
        whole = {"string_char_at": "usize", "substring": "usize", "pow": "u32"}.get(x.name)
        kind = self._strong(self.type_of(x, types), want) if x.name not in _RESULTS else None
        args = [self.expr(a, types, whole if whole and k else kind) for k, a in enumerate(x.args)]
        try:
            return self.functions[x.name](*args)
        except TypeError as error:
            raise ProgramError(f"${x.name}: {error}") from error

    # tables

    def unit(self) -> DataFrame:
        one = self.spark.range(1).select(F.lit(True).alias("v_0unit"))
        return one.withColumn(TAG, self.algebra.one()) if self.algebra.type else one

    def scan(self, atom: Atom, df: DataFrame, kinds: list[str]) -> Table:
        """The rows of a relation that fit an atom, with a column for each variable."""
        if len(atom.args) != len(kinds):
            raise ProgramError(f"relation {atom.pred} has {len(kinds)} columns, not {len(atom.args)}")
        seen: dict[str, int] = {}
        for k, (x, kind) in enumerate(zip(atom.args, kinds, strict=True)):
            if isinstance(x, Const):
                df = df.where(F.col(f"c{k}") == self.expr(x, {}, kind)[0])
            elif isinstance(x, Var):
                if x.name in seen:
                    df = df.where(F.col(f"c{k}") == F.col(f"c{seen[x.name]}"))
                else:
                    seen[x.name] = k
        columns = [F.col(f"c{k}").alias(column_of(v)) for v, k in seen.items()]
        columns = columns or [F.lit(True).alias("v_0unit")]
        if self.algebra.type:
            columns.append(F.col(TAG))
        out = df.select(*columns)
        if atom.pred in self.broadcasts:
            out = out.hint("broadcast")
        return Table(out, {v: kinds[k] for v, k in seen.items()})

    def join(self, a: Table, b: Table) -> Table:
        """Natural join; tags multiply. Without common variables, the product."""
        left, right = a.df, b.df
        common = [v for v in b.types if v in a.types]
        if self.algebra.type:
            right = right.withColumnRenamed(TAG, "__tag2")
        if "v_0unit" in left.columns and "v_0unit" in right.columns:
            right = right.drop("v_0unit")
        if common:
            for v in common:
                if a.types[v] != b.types[v]:
                    wide = max(a.types[v], b.types[v], key=lambda t: _ORDER.index(t) if t in _ORDER else -1)
                    left = left.withColumn(column_of(v), F.col(column_of(v)).cast(SPARK[wide]))
                    right = right.withColumn(column_of(v), F.col(column_of(v)).cast(SPARK[wide]))
                    a.types[v] = wide
            out = left.join(right, [column_of(v) for v in common], "inner")
        else:
            out = left.crossJoin(right)
        if self.algebra.type:
            out = out.withColumn(TAG, self.algebra.times(F.col(TAG), F.col("__tag2"))).drop("__tag2")
        return Table(out, b.types | a.types)

    def merged_rows(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Set semantics: equal rows become one, their tags are added."""
        if not self.algebra.type:
            return df.select(*columns).distinct()
        if self.algebra.parts > 1:  # the best of parts of each group, then the best of these
            part = F.pmod(F.hash(F.to_json(F.struct(TAG))), F.lit(self.algebra.parts)).alias("__part")
            df = df.groupBy(*columns, part).agg(self.algebra.sum(F.col(TAG)).alias(TAG))
        return df.groupBy(*columns).agg(self.algebra.sum(F.col(TAG)).alias(TAG))

    def without(self, a: Table, b: Table) -> Table:
        """Rows of ``a`` that ``b`` has no match for, or with tags, less what it has."""
        common = [column_of(v) for v in b.types if v in a.types]
        if not common:
            b = Table(b.df.withColumn("v_0key", F.lit(0)), b.types)
            left = a.df.withColumn("v_0key", F.lit(0))
            common = ["v_0key"]
        else:
            left = a.df
        if not self.algebra.type or self.algebra.negate(F.col(TAG)) is None:
            return Table(left.join(b.df.select(*common).distinct(), common, "left_anti").drop("v_0key"), a.types)
        right = self.merged_rows(b.df, common).withColumnRenamed(TAG, "__tag2")
        out = left.join(right, common, "left").withColumn(TAG, self.algebra.minus(F.col(TAG), F.col("__tag2"))).drop("__tag2", "v_0key")
        return Table(out, a.types)

    def foreign(self, table: Table, atom: Atom) -> Table | None:
        """A computed relation joined to a table that binds its arguments; None while they are free."""
        p = self.predicates[atom.pred]
        given, free = atom.args[: p.bound], atom.args[p.bound :]
        if len(free) != len(p.free):
            raise ProgramError(f"{atom.pred} takes {p.bound + len(p.free)} arguments")
        if any(not variables(x) <= set(table.types) or isinstance(x, Wild) for x in given):
            return None
        want = self.type_name(atom.types[0]) if atom.types else None
        for x in given:
            want = want or self._strong(self.type_of(x, table.types), None)
        args = [self.expr(x, table.types, want) for x in given]
        if want in NUMBERS and atom.pred in ("range", "float_eq", "soft_eq", "soft_neq", "soft_gt", "soft_lt"):
            args = [(c.cast(SPARK[want]), want) for c, _ in args]
        df = table.df
        if p.holds is not None:
            return Table(df.where(p.holds(*args)), table.types)
        if p.prob is not None:
            if self.algebra.type:
                fact = F.xxhash64(F.lit(atom.pred), *[c for c, _ in args])
                df = df.withColumn(TAG, self.algebra.times(F.col(TAG), self.algebra.given(p.prob(*args), fact, F.lit(None).cast("bigint"))))
            return Table(df, table.types)
        own = [x.name for x in free if isinstance(x, Var)]
        if p.once and not self.algebra.type and len(set(own)) == len(own) and not set(own) & set(table.types):
            return self._once_each(table, p, args, free)
        df = df.withColumn("__row", F.explode(p.rows(*args)))
        types = dict(table.types)
        if "tag" in p.free:
            raise ProgramError("tagged predicates give their tag with prob")
        for k, (x, kind) in enumerate(zip(free, p.free, strict=True)):
            kind = args[int(kind[1:])][1] if kind[0] == "=" else kind
            value = F.col("__row")[f"c{k}"]
            if isinstance(x, Const) or isinstance(x, Var) and x.name in types:
                df = df.where(value == self.expr(x, types, kind)[0])
            elif isinstance(x, Var):
                df = df.withColumn(column_of(x.name), value)
                types[x.name] = kind
        return Table(df.drop("__row"), types)

    def _once_each(self, table: Table, p: Predicate, args: list[Typed], free: tuple) -> Table:
        """A predicate that is dear to compute, once for each of its different arguments, in tasks of their own."""
        names = [f"__given{k}" for k in range(len(args))]
        df = table.df.withColumns({n: c for n, (c, _) in zip(names, args, strict=True)})
        made = df.select(*names).distinct().withColumn("__row", F.explode(p.rows(*[(F.col(n), t) for n, (_, t) in zip(names, args, strict=True)])))
        types, columns = dict(table.types), []
        for k, (x, kind) in enumerate(zip(free, p.free, strict=True)):
            value = F.col("__row")[f"c{k}"]
            if isinstance(x, Const):
                made = made.where(value == self.expr(x, types, kind)[0])
            elif isinstance(x, Var) and x.name not in types:
                columns.append(value.alias(column_of(x.name)))
                types[x.name] = kind
        made = made.select(*names, *columns)
        if not any(v in self.needed for v in table.types):  # only what is computed goes on
            return Table(made.select(F.lit(True).alias("v_0unit"), *[c for c in made.columns if c not in names]), {v: t for v, t in types.items() if v not in table.types})
        return Table(df.join(made, names).drop(*names), types)

    def parsed(self, table: Table, x: Any) -> Typed | None:
        """The term in a text as a column, where ``x`` asks for it: each different text is parsed once."""
        if not isinstance(x, Call) or x.name != "parse_entity" or len(x.args) != 1 or not isinstance(x.args[0], Var) or x.args[0].name not in table.types:
            return None
        text, made = column_of(x.args[0].name), f"__term_{column_of(x.args[0].name)}"
        if made not in table.df.columns:
            terms = table.df.select(text).distinct().withColumn(made, self.expr(x, table.types)[0]).where(F.col(made).isNotNull())
            table.df = table.df.join(terms, text)
        return F.col(made), "Entity"

    def foreign_not(self, table: Table, atom: Atom) -> Table:
        """Rows for which a computed predicate of bound arguments doesn't hold."""
        p = self.predicates[atom.pred]
        args = [self.expr(x, table.types) for x in atom.args[: p.bound]]
        if p.holds is not None:
            return Table(table.df.where(~p.holds(*args)), table.types)
        if p.rows is None:
            raise ProgramError(f"{atom.pred} can't be negated")
        wanted = [(k, x) for k, x in enumerate(atom.args[p.bound :]) if not isinstance(x, Wild)]
        values = [(k, self.expr(x, table.types, None if p.free[k][0] == "=" else p.free[k])[0]) for k, x in wanted]

        def same(row: Column) -> Column:
            out = F.lit(True)
            for k, value in values:
                out = out & (row[f"c{k}"] == value)
            return out

        return Table(table.df.where(~F.exists(p.rows(*args), same)), table.types)

    # bodies

    def body(self, literals: tuple, rel: Callable[[int, str], tuple[DataFrame, list[str]]], outer: set[str]) -> Table:
        """The table of a body. ``rel`` gives the rows and types of the relation at a literal; ``outer``: variables that the head needs."""
        left = list(enumerate(literals))
        table = Table(None, {})

        def needs(x: Any) -> set[str]:
            return variables(x)

        def started() -> DataFrame:
            if table.df is None:
                table.df = self.unit()
            return table.df

        while left:
            done = None
            for k, x in left:
                if isinstance(x, Check) and self._check(table, x.expr, started):
                    done = k
                elif isinstance(x, Atom) and x.pred in self.predicates and rel(k, x.pred) is None:
                    self.needed = outer.union(*[variables(y) for n, y in left if n != k])
                    found = self.foreign(Table(started(), table.types), x) if needs(Atom("", x.args[: self.predicates[x.pred].bound])) <= set(table.types) else None
                    if found is not None:
                        table, done = found, k
                elif isinstance(x, Not) and needs(x) <= set(table.types) and x.of.pred in self.predicates and rel(k, x.of.pred) is None:
                    table, done = self.foreign_not(Table(started(), table.types), x.of), k
                elif isinstance(x, Not) and needs(x) <= set(table.types):
                    df, kinds = rel(k, x.of.pred)
                    table, done = self.without(Table(started(), table.types), self.scan(x.of, df, kinds)), k
                if done is not None:
                    break
            if done is None:
                done = self._next(table, left)
                if done is None:
                    done = self._last(table, left, rel, outer, literals, started)
                else:
                    made = self._rows(dict(left)[done], done, rel, outer, literals)
                    table = made if table.df is None else self.join(table, made)
            left = [(k, x) for k, x in left if k != done]
        started()
        return table

    def _next(self, table: Table, left: list) -> int | None:
        """The atom or aggregate that shares most with what is bound; constants count too."""
        best, most = None, -1.0
        for k, x in left:
            if isinstance(x, Atom) and x.pred in self.predicates and x.pred not in self.known:
                continue
            if isinstance(x, Atom):
                shared = len({v for a in x.args for v in variables(a)} & set(table.types))
                score = shared * 10 + sum(isinstance(a, Const) for a in x.args) + (0.5 if k in self.first else 0)
            elif isinstance(x, Aggregate):
                score = len(variables(x) & set(table.types)) * 10
            else:
                continue
            if table.df is None and k in self.first:
                return k
            if score > most:
                best, most = k, score
        return best

    known: set[str] = set()
    first: set[int] = set()
    #: Variables that the head or other literals read.
    needed: set[str] = set()
    #: Relations that rules derive, and the rows of others before equal ones are merged.
    derived: set[str] = set()
    raw: dict[str, DataFrame] = {}
    #: Rows of atoms that are scanned already, by their place in the body.
    scanned: dict[int, DataFrame] = {}
    #: Whether rows whose tag says so are dropped as soon as they are derived.
    discards = True

    def _rows(self, x: Any, k: int, rel: Callable, outer: set[str], literals: tuple) -> Table:
        if isinstance(x, Atom):
            df, kinds = rel(k, x.pred)
            made = self.scan(x, df, kinds)
            return Table(self.scanned.get(k, made.df), made.types)
        others = outer | {v for n, y in enumerate(literals) if n != k for v in variables(y)}
        return self.reduced(x, rel, others)

    def _last(self, table: Table, left: list, rel: Callable, outer: set[str], literals: tuple, started: Callable) -> int:
        """What only filters: exists, when everything else is bound."""
        for k, x in left:
            if isinstance(x, Exists):
                shared = variables(x) & set(table.types)
                inner = self._union(x.bodies, rel, shared | {g.name for g in x.groups})
                if x.where:
                    domain = self._union(x.where, rel, {g.name for g in x.groups})
                    shared = {g.name for g in x.groups}
                    inner = self._only(inner, shared)
                    whole = self.without(domain, inner) if x.negated else self.join(domain, inner)
                    whole = self._only(whole, shared)
                    joined = whole if table.df is None else self.join(table, whole)
                    table.df, table.types = joined.df, joined.types
                    return k
                inner = self._only(inner, shared & set(inner.types))
                made = self.without(Table(started(), table.types), inner) if x.negated else self.join(Table(started(), table.types), inner)
                table.df, table.types = made.df, made.types
                return k
        free = sorted({v for _, x in left for v in variables(x)} - set(table.types))
        raise ProgramError(f"variables are not bound: {', '.join(free)}")

    def _only(self, table: Table, names: set[str]) -> Table:
        names = [v for v in table.types if v in names]
        columns = [column_of(v) for v in names] or ["v_0unit"]
        df = table.df if "v_0unit" in table.df.columns or names else table.df.withColumn("v_0unit", F.lit(True))
        return Table(self.merged_rows(df, columns), {v: table.types[v] for v in names})

    def _check(self, table: Table, e: Any, started: Callable) -> bool:
        """Filter, or bind one variable. False while more than one is free."""
        free = variables(e) - set(table.types)
        if not free:
            column, kind = self.expr(e, table.types)
            if kind != "bool":
                raise TypeProblem(f"a condition must be bool, not {kind}")
            table.df = started().where(column)
            return True
        if len(free) == 1 and isinstance(e, Binary) and e.op == "==":
            (name,) = free
            made = solve(e.left, e.right, name)
            if made is not None:
                column, kind = self.expr(made, table.types, self.hints.get(name))
                table.df = started().withColumn(column_of(name), column).where(F.col(column_of(name)).isNotNull())
                table.types = table.types | {name: kind}
                return True
        return False

    hints: dict[str, str] = {}

    def _union(self, bodies: tuple, rel: Callable, outer: set[str]) -> Table:
        parts = []
        keep = self.known, self.first
        for b in bodies:
            self.first = set()
            parts.append(self.body(b, lambda _, p: rel(-1, p), outer))
        self.known, self.first = keep
        if len(parts) == 1:
            return parts[0]
        names = [v for v in parts[0].types if all(v in p.types for p in parts)]
        columns = [column_of(v) for v in names] + ([TAG] if self.algebra.type else [])
        if not names:
            columns = ["v_0unit", *columns]
        df = None
        for p in parts:
            rows = (p.df if names or "v_0unit" in p.df.columns else p.df.withColumn("v_0unit", F.lit(True))).select(*columns)
            df = rows if df is None else df.unionByName(rows)
        return Table(df, {v: parts[0].types[v] for v in names})

    def reduced(self, x: Aggregate, rel: Callable, outer: set[str]) -> Table:
        """An aggregate literal: its group variables and outputs."""
        r = x.reduce
        self.check_aggregate(r.op)
        inner = self._union(x.bodies, rel, outer | {v.name for v in (*r.args, *r.bindings)})
        args, values = [a.name for a in r.args], [b.name for b in r.bindings]
        for v in (*args, *values):
            if v not in inner.types:
                raise ProgramError(f"variable {v} is not bound in {r.op}")
        groups = [g.name for g in r.groups] if x.where else [v for v in inner.types if v in outer and v not in args and v not in values and v not in {o.name for o in r.outs}]
        if r.op == "exists" and not values or not values and not args:
            values = [v for v in inner.types if v not in groups]
        names = [*groups, *args, *values]
        spec = Spec(r.op, parameters(r.op, r.params) if r.op in NAMES else {}, [column_of(v) for v in groups], [column_of(v) for v in args], [column_of(v) for v in values], [inner.types[v] for v in values], [inner.types[v] for v in args], r.hard)
        df = inner.df if names or "v_0unit" in inner.df.columns else inner.df.withColumn("v_0unit", F.lit(True))
        rows = self.merged_rows(df, [column_of(v) for v in names] or ["v_0unit"])
        if not names:
            spec.values = ["v_0unit"]
        domain = None
        if x.where:
            domain = self._only(self._union(x.where, rel, set(groups)), set(groups)).df
        if r.op in self.aggregates:
            function, kind = self.aggregates[r.op]
            df = rows.groupBy(*spec.groups).agg(function(*[F.col(c) for c in (*spec.args, *spec.values)]).cast(SPARK[kind]).alias("o0")).where("o0 is not null")
            df, kinds = (df.withColumn(TAG, self.algebra.one()) if self.algebra.type else df), [kind]
        else:
            df, kinds = aggregate(rows, spec, self.algebra, domain), output_types(spec)
        if len(kinds) != len(r.outs):
            raise ProgramError(f"{r.op} gives {len(kinds)} values, not {len(r.outs)}")
        out = df.select(*spec.groups, *[F.col(f"o{k}").alias(column_of(o.name)) for k, o in enumerate(r.outs)], *([TAG] if self.algebra.type else []))
        types = {g: inner.types[g] for g in groups if g in inner.types} | {o.name: t for o, t in zip(r.outs, kinds, strict=True)}
        return Table(out, types)

    # rules

    def keyed(self, rule: FlatRule, rel: Callable, kinds: list[str]) -> list[DataFrame] | None:
        """The rows of a rule in parts, of which the first is distinct as it is, where merging would gather many times what is read.

        That is a join on variables that the head lacks, or a predicate that computes rows. The head has variables that occur once in
        the rows of one atom, which give its others; the head has all further variables. So its rows come
        once from each such row. The rows of that atom whose head variables repeat are a part that has to be merged. None: not such a rule,
        or over derived relations, which would be computed twice for it.
        """
        head = [x.name for x in rule.head.args if isinstance(x, Var)]
        atoms = [(k, x) for k, x in enumerate(rule.body) if isinstance(x, Atom) and rel(k, x.pred) is not None]
        computed = [x for k, x in enumerate(rule.body) if isinstance(x, Atom) and rel(k, x.pred) is None]
        checks = [x for x in rule.body if isinstance(x, Check)]
        if self.algebra.type or any(x.pred in self.derived for _, x in atoms) or len(set(head)) != len(rule.head.args) or len(atoms) + len(computed) + len(checks) != len(rule.body):
            return None
        names = {k: {v for a in x.args for v in variables(a)} for k, x in atoms}
        if len(atoms) == 2 and not computed:
            (one, _), (two, _) = atoms
            if not names[one] & names[two] or names[one] & names[two] <= set(head) or not names[one] & set(head) or not names[two] & set(head):
                return None
        elif len(atoms) != 1 or not computed:
            return None
        for x in computed:
            p = self.predicates.get(x.pred)
            if p is None or p.holds is None and p.prob is None and (not p.unique or not all(isinstance(a, Var) and a.name in head for a in x.args[p.bound :])):
                return None
            if p.holds is None and ({a.name for a in x.args[p.bound :]} & {v for n in names.values() for v in n} or len({a.name for a in x.args[p.bound :]}) < len(p.free)):
                return None
        for k, x in atoms:
            df, types = rel(k, x.pred)
            key = [v for v in names[k] if v in head]
            if not key or not all(names[j] <= names[k] | set(head) for j, _ in atoms) or len(types) != len(x.args):
                continue
            known = self.body_types(rule.body, lambda n: rel(-1, n)[1] if rel(-1, n) is not None else None, set())
            if any(known.get(v) != t for v, t in zip(head, kinds, strict=True)):
                return None
            whole = self.scan(x, self.raw.get(x.pred, df), types)
            columns = [column_of(v) for v in sorted(key)]
            often = whole.df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*columns)
            parts = [whole.df]
            if not often.isEmpty():
                often = written(often, "often")
                parts = [whole.df.join(often, columns, "left_anti"), whole.df.join(often, columns, "left_semi")]
            out = []
            for n, part in enumerate(parts):
                if len(atoms) == 2:  # what joins is many times what is read, so it is made in many tasks
                    part = part.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *columns)
                self.scanned = {k: part.select(*whole.df.columns)} | {j: self.scan(y, *rel(j, y.pred)).df.distinct() for j, y in atoms if j != k}
                out.append(self.rule(rule, rel, kinds))
            self.scanned = {}
            return out
        return None

    def rule(self, rule: FlatRule, rel: Callable, kinds: list[str], first: set[int] | None = None, hints: dict | None = None) -> DataFrame:
        """The rows that a rule derives: c0, c1, ... and the tag; not yet merged."""
        outer = variables(rule.head) | (variables(rule.tag) if rule.tag is not None else set())
        self.first, self.hints = first or set(), hints or {}
        table = self.body(rule.body, rel, outer)
        columns = []
        for k, (x, kind) in enumerate(zip(rule.head.args, kinds, strict=True)):
            if isinstance(x, Wild):
                raise ProgramError("a wildcard can't be in a head")
            column, own = self.parsed(table, x) or self.expr(x, table.types, kind)
            columns.append((column if own == kind else column.cast(SPARK[kind])).alias(f"c{k}"))
        if not columns:
            columns = [F.lit(True).alias("c0")]
        if self.algebra.type:
            columns.append(self._tag(rule, table).alias(TAG))
        df = table.df.select(*columns)
        for k in range(len(kinds)):
            df = df.where(F.col(f"c{k}").isNotNull())
        if self.discards and self.algebra.type and self.algebra.discard(F.col(TAG)) is not None:
            df = df.where(~self.algebra.discard(F.col(TAG)))
        return df

    def _tag(self, rule: FlatRule, table: Table) -> Column:
        if rule.overwrite:
            return self.algebra.one()
        tag = F.col(TAG)
        names = [F.col(column_of(v)) for v in sorted(table.types)]
        if rule.tag is not None:
            value, kind = self.expr(rule.tag, table.types, "f64")
            if kind not in NUMBERS | {"bool"}:
                raise ProgramError(f"a tag is a number or a bool, not {kind}")
            fact = F.xxhash64(F.lit(str(rule.head)), *names)
            tag = self.algebra.times(tag, self.algebra.given(value, fact, F.lit(None).cast("bigint")))
        if rule.choice is not None and self.algebra.proofs:
            n, k = rule.choice
            group = F.xxhash64(F.lit(str(rule.body)), *names)
            tag = self.algebra.times(tag, self.algebra.given(F.lit(1.0 / n), F.xxhash64(group, F.lit(k)), group))
        return tag
