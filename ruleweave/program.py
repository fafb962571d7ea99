"""Programs: relations, facts and rules on a SparkSession.

>>> p = Program(spark)
>>> p.add_table("edge", edges)
>>> p.add('rel path(x, y) = edge(x, y) or (path(x, z) and edge(z, y))')
>>> p.relation("path").show()
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalar import TypeProblem
from .functions.table import Predicate, soft_comparisons
from .functions.terms import term_function, term_predicates
from .operators.fixpoint import Options, empty, fixpoint
from .operators.tags import TAG, Algebra, algebra
from .plans import normal
from .plans.evaluate import Evaluator, python_value
from .plans.normal import FlatRule, predicates
from .plans.parser import parse
from .plans.strata import strata
from .plans.syntax import Atom, Const, Import, ProgramError, Query, Rule, Var, Wild
from .sources.csv import PROB, read_csv, write_csv
from .storage import ship, written
from .types import SPARK, of_spark


class Program:
    """A program that can be extended and run again; what didn't change isn't computed again."""

    def __init__(self, spark: SparkSession, provenance: str | Algebra = "unit", k: int = 3, seed: int = 1234, early_discard: bool = True) -> None:
        self.spark, self.algebra, self.seed, self.early_discard = spark, algebra(provenance, k), seed, early_discard
        ship(spark)
        self.source = normal.Program()
        self.tables: dict[str, list[DataFrame]] = {}
        self.versions: dict[str, int] = {}
        self.functions: dict[str, Callable] = {}
        self.predicates: dict[str, Predicate] = {}
        self.aggregates: dict[str, tuple[Callable, str]] = {}
        self.attribute_handlers: dict[str, Callable] = {}
        self.memo: dict[str, tuple[Any, DataFrame]] = {}
        self.results: dict[str, DataFrame] = {}
        self.rounds: dict[str, int] = {}
        self.monitors: list[Callable[[str, dict], None]] = []
        self._imports: list[str] = []
        self._facts = 0

    # building

    def add(self, text: str, folder: str = ".") -> Program:
        """Items of the text dialect."""
        for item in parse(text):
            if isinstance(item, Import):
                self.add_file(str(Path(folder) / item.path))
                continue
            for a in getattr(item, "attributes", ()):
                if a.name in self.attribute_handlers:
                    item = self.attribute_handlers[a.name](item, *a.args, **dict(a.named)) or item
            self.source.add(item)
        self.results = {}
        return self

    def add_file(self, path: str) -> Program:
        """A program file; its imports are relative to it, and each file is taken once."""
        path = str(Path(path).resolve())
        if path in self._imports:
            return self
        self._imports.append(path)
        return self.add(Path(path).read_text(), str(Path(path).parent))

    def add_relation(self, name: str, kinds: Sequence[str]) -> Program:
        return self.add(f"type {name}({', '.join(kinds)})")

    def add_rule(self, text: str, tag: float | None = None) -> Program:
        """A rule; with ``tag``, of this probability."""
        if tag is None:
            return self.add(f"rel {text}")
        before = {h: len(n) for h, n in self.source.rule_tags.items()}
        self.add(f"@tagged\nrel {text}")
        head = next(h for h, n in self.source.rule_tags.items() if len(n) > before.get(h, 0))
        return self.tag_rule(head, tag, len(self.source.rule_tags[head]) - 1)

    def tag_rule(self, head: str, tag: float, number: int = 0) -> Program:
        """Give a rule that is marked ``@tagged`` its probability, the ``number``-th such rule of its head. Without one it derives nothing."""
        name = self.source.rule_tags[head][number]
        self.source.facts[name] = [((), float(tag), None)]
        self.versions[name] = self.versions.get(name, 0) + 1
        self.results = {}
        return self

    def soft_comparison(self, shape: str = "logistic", beta: float = 1.0) -> Program:
        """The sigmoid of soft_gt, soft_lt, soft_eq and soft_neq (a key of SIGMOIDS) and the steepness of it."""
        self.predicates |= soft_comparisons(shape, beta)
        self.memo, self.results = {}, {}
        return self

    def monitor(self, listener: Callable[[str, dict], None]) -> Program:
        """A function that is told ("round", {stratum, round, rows by relation}) after each round and ("relation", {name, seconds}) after each stratum."""
        self.monitors.append(listener)
        return self

    def add_facts(self, name: str, rows: Iterable[Sequence] | DataFrame, tags: Sequence[float] | None = None) -> Program:
        """Facts from Python rows or a DataFrame; relations that depend on them are computed again."""
        if isinstance(rows, DataFrame):
            return self.add_table(name, rows)
        rows = list(rows)
        known = self.source.columns.get(name)
        for n, row in enumerate(rows):
            row = row if isinstance(row, (tuple, list)) else (row,)
            self.source.arity(name, len(row))
            kinds = [(known or [None] * len(row))[k] or ("int?" if isinstance(v, int) and not isinstance(v, bool) else "float?" if isinstance(v, float) else "bool" if isinstance(v, bool) else "String") for k, v in enumerate(row)]
            self.source.facts.setdefault(name, []).append((tuple(zip(row, kinds, strict=True)), tags[n] if tags else None, None))
        self.versions[name] = self.versions.get(name, 0) + 1
        self.results = {}
        return self

    def add_table(self, name: str, df: DataFrame, tag: str | None = None) -> Program:
        """A DataFrame as facts; rows with nulls are left out. ``tag``: the column of their probabilities."""
        kinds = [of_spark(f.dataType) for f in df.schema.fields if f.name != tag]
        self.source.arity(name, len(kinds))
        self.source.columns[name] = [a or b for a, b in zip(self.source.columns[name], kinds, strict=True)]
        names = [f.name for f in df.schema.fields if f.name != tag]
        columns = [F.col(f"`{c}`").cast(SPARK[t]).alias(f"c{k}") for k, (c, t) in enumerate(zip(names, self.source.columns[name], strict=True))]
        rows = df.select(*columns, *([F.col(f"`{tag}`").cast("double").alias(PROB)] if tag else [])).dropna(subset=[f"c{k}" for k in range(len(kinds))])
        self.tables.setdefault(name, []).append(rows)
        self.versions[name] = self.versions.get(name, 0) + 1
        self.results = {}
        return self

    def add_csv(self, name: str, path: str, kinds: Sequence[str] | None = None, **options: Any) -> Program:
        """A CSV file as facts; options as in ``read_csv``."""
        given = self.source.columns.get(name)
        df = read_csv(self.spark, path, list(kinds) if kinds else given if given and all(given) else None, **options)
        return self.add_table(name, df, PROB if PROB in df.columns else None)

    def function(self, name: str, kinds: Sequence[str], result: str, python: Callable | None = None, columns: Callable[..., Column] | None = None) -> Program:
        """A scalar function: of Columns, or a Python function of values, row by row (an Arrow or pandas UDF can be given as ``columns``). None drops the row."""
        made = columns or F.udf(python, SPARK[result])

        def call(*args: tuple) -> tuple:
            if len(args) != len(kinds):
                raise ProgramError(f"${name} takes {len(kinds)} arguments")
            return made(*[c.cast(SPARK[t]) for (c, _), t in zip(args, kinds, strict=True)]), result

        call.result = result
        self.functions[name] = call
        return self

    def predicate(self, name: str, bound: Sequence[str], free: Sequence[str], python: Callable) -> Program:
        """A table function: from bound arguments, a Python function yields tuples of the free ones."""
        self.source.computed.add(name)
        schema = T.ArrayType(T.StructType([T.StructField(f"c{k}", SPARK[t]) for k, t in enumerate(free)]))
        made = F.udf(lambda *a: [x if isinstance(x, tuple) else (x,) for x in python(*a)], schema)
        self.predicates[name] = Predicate(len(bound), tuple(free), rows=lambda *args: made(*[c.cast(SPARK[t]) for (c, _), t in zip(args, bound, strict=True)]))
        return self

    def tagged_predicate(self, name: str, bound: Sequence[str], python: Callable) -> Program:
        """A predicate of bound arguments that holds with the probability that a Python function gives."""
        self.source.computed.add(name)
        made = F.udf(python, "double")
        self.predicates[name] = Predicate(len(bound), prob=lambda *args: made(*[c for c, _ in args]))
        return self

    def aggregate(self, name: str, result: str, function: Callable[..., Column]) -> Program:
        """An aggregate: an aggregating function of Columns, as ``F.median`` or a grouped pandas UDF."""
        self.aggregates[name] = function, result
        return self

    def attribute(self, name: str, handler: Callable) -> Program:
        """A handler for ``@name(...)``: takes the item and the arguments, returns another item or None."""
        self.attribute_handlers[name] = handler
        return self

    # running

    def run(self, limit: int | None = None, scheduler: str = "lfp", beam: int = 3, stop_at_goal: bool = False, only: Iterable[str] | None = None) -> Program:
        """Compute all relations, or those that ``only`` needs."""
        options = Options(limit, scheduler.replace("_", "-").replace("a-star", "astar").replace("astar", "a-star"), beam, stop_at_goal, set(self.source.goals))
        variants = {c: tuple(self.source.columns[c][1:]) for c in self.source.variants}
        functions = self.functions | {"parse_entity": term_function(variants)}
        evaluator = Evaluator(self.spark, self.algebra, functions, self.predicates | term_predicates(variants), self.aggregates, self.source.broadcasts, self.source.type)
        evaluator.discards = self.early_discard
        options.tell = self._tell if self.monitors else None
        rules = self.source.with_demand()
        kinds = self._types(evaluator, rules)
        self.kinds, self.results = kinds, {}
        heads = {r.head.pred for r in rules}
        wanted = None
        if only is not None:
            wanted = {*only, *(f"demand#{n}" for n in only if n in self.source.demands)}
        groups = strata(rules, wanted) if wanted is not None else strata(rules)
        groups = [g for g in groups if any(n in kinds for n in g)]  # the others are computed predicates
        placed = {n for g in groups for n in g}
        sources = set(self.tables) | set(self.source.facts) | set(self.source.files) | set(self.source.entities) | (wanted or set())
        groups = [[n] for n in sorted(sources - placed) if wanted is None or n in wanted] + groups
        done: dict[str, DataFrame] = {}
        keys: dict[str, Any] = {}

        def outside(name: str) -> tuple[DataFrame, list[str]] | None:
            if name in done:
                return done[name], kinds[name]
            if name in evaluator.predicates and name not in kinds:
                return None
            return empty(self.spark, kinds.get(name) or [], self.algebra.type), kinds.get(name) or []

        evaluator.known, evaluator.derived, evaluator.raw = set(kinds), heads, {}
        for group in groups:
            own = [r for r in rules if r.head.pred in group]
            used = sorted({n for r in own for n, _ in predicates(r.body)} - set(group))
            key = (tuple(map(str, own)), tuple((n, self.versions.get(n, 0), str(self.source.facts.get(n)), str(kinds.get(n)), str(sorted(self.source.entities.get(n, ()), key=str))) for n in group), tuple(str(keys.get(n)) for n in used), options.limit, options.scheduler, options.beam)
            keys.update(dict.fromkeys(group, hash(str(key))))
            if all(n in self.memo and self.memo[n][0] == key for n in group):
                done |= {n: self.memo[n][1] for n in group}
                continue
            base = {n: b for n in group if (b := self._base(n, kinds[n])) is not None}
            inside = any(n in group for r in own for n, _ in predicates(r.body))
            hints = lambda r: evaluator.body_types(r.body, lambda n: kinds.get(n), set())
            begin = time.time()
            try:
                if inside:
                    named = [self.source.schedulers[n] for n in group if n in self.source.schedulers]
                    chosen = copy.copy(options)
                    if named:
                        chosen.scheduler, chosen.beam = named[0].args[0], int(named[0].get("beam_size", 1, options.beam))
                    found, rounds = fixpoint(evaluator, group, own, kinds, base, outside, chosen, hints)
                    self.rounds |= dict.fromkeys(group, rounds)
                else:
                    found = {n: self._once(evaluator, n, [r for r in own if r.head.pred == n], base.get(n), kinds, outside, hints) for n in group}
            except TypeProblem as error:
                raise ProgramError(f"type error: {error}") from error
            for n, df in found.items():
                # what several later relations read is computed once
                readers = sum(n in {p for p, _ in predicates(r.body)} for r in rules)
                if not inside and n in heads and readers > 1:
                    df = written(df, "relation")
                done[n] = df
                self.memo[n] = key, df
                self._tell("relation", {"name": n, "seconds": time.time() - begin})
            if stop_at_goal and options.goals and options.goals <= set(done) and all(not done[g].isEmpty() for g in options.goals):
                break
        self.results = done
        self._write_outputs()
        return self

    def _tell(self, event: str, data: dict) -> None:
        for listener in self.monitors:
            listener(event, data)

    def _once(self, evaluator: Evaluator, name: str, rules: list[FlatRule], base: DataFrame | None, kinds: dict, outside: Callable, hints: Callable) -> DataFrame:
        parts = [] if base is None else [base]
        columns = [f"c{k}" for k in range(len(kinds[name]))] or ["c0"]
        if base is not None and not rules:
            evaluator.raw[name] = base
        if base is None and len(rules) == 1 and (found := evaluator.keyed(rules[0], lambda _, p: outside(p), kinds[name])) is not None:
            return found[0] if len(found) == 1 else found[0].unionByName(evaluator.merged_rows(found[1], columns))
        for r in rules:
            parts.append(evaluator.rule(r, lambda _, p: outside(p), kinds[name], None, hints(r)))
        if not parts:
            return empty(self.spark, kinds[name], self.algebra.type)
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return evaluator.merged_rows(df, columns)

    def _types(self, evaluator: Evaluator, rules: list[FlatRule]) -> dict[str, list[str]]:
        kinds: dict[str, list] = {n: list(c) for n, c in self.source.columns.items()}
        for name, types in kinds.items():
            kinds[name] = [self.source.type(t) if t is not None else None for t in types]
        fixed = {n: [t is not None for t in c] for n, c in kinds.items()}
        for name, rows in self.source.facts.items():
            for values, _, _ in rows:
                for k, (_, t) in enumerate(values):
                    if not fixed[name][k]:
                        kinds[name][k] = evaluator.merged(kinds[name][k], t)
        for _ in range(len(rules) + 2):
            before = str(kinds)
            for r in rules:
                known = evaluator.body_types(r.body, lambda n: kinds.get(n), set())
                own = kinds.setdefault(r.head.pred, [None] * len(r.head.args))
                for k, x in enumerate(r.head.args):
                    if not fixed.get(r.head.pred, [False] * len(own))[k]:
                        own[k] = evaluator.merged(own[k], evaluator.type_of(x, known))
            if str(kinds) == before:
                break
        strong = {"int?": "i32", "float?": "f32", None: "i32"}
        return {n: [strong.get(t, t) for t in c] for n, c in kinds.items()}

    def _base(self, name: str, kinds: list[str]) -> DataFrame | None:
        """The facts of a relation with their tags."""
        columns = [f"c{k}" for k in range(len(kinds))] or ["c0"]
        parts: list[DataFrame] = []
        if name in self.source.files and name not in self.tables:
            a = self.source.files[name]
            named = dict(a.named)
            given = self.source.columns.get(name)
            df = read_csv(self.spark, a.args[0], given if given and all(given) else None, named.get("deliminator", ","), named.get("has_header", False), named.get("has_probability", False), named.get("keys"), named.get("fields"))
            self.tables[name] = [df]
        for df in self.tables.get(name, []):
            prob = F.col(PROB) if PROB in df.columns else F.lit(None).cast("double")
            parts.append(df.select(*columns, *self._fact_tag(prob, F.xxhash64(F.lit(name), *columns), F.lit(None).cast("bigint"))))
        rows = self.source.facts.get(name, []) if kinds else [((("", "bool"),), tag, group) for _, tag, group in self.source.facts.get(name, [])]
        made = []
        for values, tag, group in rows:
            self._facts += 1
            row = [python_value(v, t) for (v, _), t in zip(values, kinds, strict=False)] if kinds else [True]
            made.append((*row, None if tag is None else float(tag), self._facts, group))
        for row in sorted(self.source.entities.get(name, ()), key=str):
            self._facts += 1
            made.append((*[python_value(v, t) for v, t in zip(row, kinds, strict=True)], None, self._facts, None))
        if made:
            fields = [T.StructField(c, SPARK[t]) for c, t in zip(columns, kinds or ["bool"], strict=True)]
            fields += [T.StructField("__p", T.DoubleType()), T.StructField("__fact", T.LongType()), T.StructField("__group", T.LongType())]
            df = self.spark.createDataFrame(made, T.StructType(fields))
            parts.append(df.select(*columns, *self._fact_tag(F.col("__p"), F.col("__fact"), F.col("__group"))))
        if not parts:
            return None
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return df

    def _fact_tag(self, prob: Column, fact: Column, group: Column) -> list[Column]:
        a = self.algebra
        if not a.type:
            return []
        untagged = a.one() if a.name != "proofs" else a.given(prob, fact, group)
        return [F.when(prob.isNull(), untagged).otherwise(a.given(prob, fact, group)).alias(TAG)]

    # results

    def relation(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """A relation's rows, with ``tag`` last if the algebra has tags. Nullary relations have no column but that."""
        if name not in self.results:
            self.run(only=[name])
        if name not in self.results:
            raise ProgramError(f"unknown relation {name}")
        return self._shown(self.results[name], self.kinds[name], columns)

    def _shown(self, df: DataFrame, kinds: list[str], columns: Sequence[str] | None) -> DataFrame:
        names = columns or [f"c{k}" for k in range(len(kinds))]
        out = [F.col(f"c{k}").alias(n) for k, n in enumerate(names)]
        if self.algebra.type:
            out.append(self.algebra.recover(F.col(TAG)).alias("tag"))
        return df.select(*(out or [F.lit(True).alias("holds")]))

    def tags(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """A relation's rows with their tags as they are kept: proofs, dual numbers and so on."""
        self.relation(name)
        names = columns or [f"c{k}" for k in range(len(self.kinds[name]))]
        return self.results[name].select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], *([F.col(TAG).alias("tag")] if self.algebra.type else []))

    def query(self, text: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows of a query item (the last by default): those of its relation that fit its arguments."""
        found = self.source.queries[-1] if text is None else next((q for q in self.source.queries if q.text == text), None)
        if found is None:
            item = parse(f"query {text}")[0]
            self.source.add(item)
            self.results, found = {}, item
        name = found.atom.pred if isinstance(found.atom, Atom) else found.atom
        if name not in self.results:
            self.run(only=[name])
        df, kinds = self.results[name], self.kinds[name]
        if isinstance(found.atom, Atom):
            evaluator = Evaluator(self.spark, self.algebra, self.functions, aliases=self.source.type)
            seen: dict[str, int] = {}
            for k, x in enumerate(found.atom.args):
                x = self.source.expr(x, {})
                if isinstance(x, Var):
                    if x.name in seen:
                        df = df.where(F.col(f"c{k}") == F.col(f"c{seen[x.name]}"))
                    seen.setdefault(x.name, k)
                elif not isinstance(x, Wild):
                    df = df.where(F.col(f"c{k}") == evaluator.expr(x, {}, kinds[k])[0])
        return self._shown(df, kinds, columns)

    def _write_outputs(self) -> None:
        for text, a in self.source.outputs.items():
            query = next(q for q in self.source.queries if q.text == text)
            name = query.atom.pred if isinstance(query.atom, Atom) else query.atom
            if name in self.results:
                df = self.query(text)
                write_csv(df.drop("tag"), a.args[0], dict(a.named).get("deliminator", ","))

    def outputs(self) -> list[str]:
        """The queries, or without any all relations with rules that aren't hidden."""
        if self.source.queries:
            return [q.text for q in self.source.queries]
        return [n for n in dict.fromkeys([*self.source.facts, *(r.head.pred for r in self.source.rules)]) if n not in self.source.hidden]

    def entity(self, term: str) -> int:
        """The id of a constant term, whose parts become facts."""
        item = parse(f"const X = {term}")[0]
        made = self.source.expr(item.value, {})
        self.results = {}
        return made.of.value

    def explain(self, name: str) -> str:
        """The physical plan of a relation."""
        return self.relation(name)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def copy(self) -> Program:
        """A program that can go its own way."""
        other = copy.copy(self)
        other.source = copy.deepcopy(self.source)
        for name in ("tables", "versions", "functions", "predicates", "aggregates", "attribute_handlers", "memo", "rounds"):
            setattr(other, name, dict(getattr(self, name)))
        other.tables = {k: list(v) for k, v in self.tables.items()}
        other.results = {}
        return other

    def batch(self, inputs: dict[str, DataFrame], name: str, key: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The relation for every independent set of facts at once.

        The tables of ``inputs`` have the batch in their column ``key``. All relations that depend on them
        get the batch as a further first column, so that batches never meet.
        """
        other = self.copy()
        rules = other.source.rules
        spread = set(inputs)
        while True:
            more = {r.head.pred for r in rules if any(p in spread for p, _ in predicates(r.body))} - spread
            if not more:
                break
            spread |= more
        var = Var("#batch")
        kind = of_spark(next(iter(inputs.values())).schema[key].dataType)
        other.source.rules = [_batched(r, spread, var) for r in rules]
        for n in spread:
            if n in other.source.columns:
                other.source.columns[n] = [kind, *other.source.columns[n]]
            if n not in inputs and (n in other.source.facts or n in other.tables):
                raise ProgramError(f"{n} has facts that belong to no batch")
        other.memo = {}
        for n, df in inputs.items():
            other.source.columns.setdefault(n, [None] * len(df.columns))
            other.add_table(n, df.select(key, *[c for c in df.columns if c != key]))
        names = [key, *(columns or [f"c{k}" for k in range(len(other.source.columns[name]) - 1)])]
        return other.relation(name, names)


def _batched(rule: FlatRule, spread: set[str], var: Var) -> FlatRule:
    from dataclasses import replace

    def atom(a: Atom) -> Atom:
        return Atom(a.pred, (var, *a.args), a.types) if a.pred in spread else a

    def literal(x: Any) -> Any:
        if isinstance(x, Atom):
            return atom(x)
        if isinstance(x, normal.Not):
            return normal.Not(atom(x.of))
        if isinstance(x, normal.Exists):
            return replace(x, bodies=tuple(tuple(map(literal, b)) for b in x.bodies), where=tuple(tuple(map(literal, b)) for b in x.where), groups=(*x.groups, var) if x.where else x.groups)
        if isinstance(x, normal.Aggregate):
            reduce = replace(x.reduce, groups=(*x.reduce.groups, var)) if x.where else x.reduce
            return normal.Aggregate(reduce, tuple(tuple(map(literal, b)) for b in x.bodies), tuple(tuple(map(literal, b)) for b in x.where))
        return x

    return replace(rule, head=atom(rule.head), body=tuple(map(literal, rule.body)))


__all__ = ["Const", "Program", "ProgramError", "Query", "Rule"]
