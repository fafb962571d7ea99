"""Semi-naive evaluation of one stratum.

Each round evaluates every recursive rule once per recursive atom, with that atom on the rows that were new in the last
round, atoms before it on older rows and atoms after it on all, so every derivation is found once. Rounds are written to
the shared folder, which cuts the lineage and survives lost executors. A relation grows by parts: each round writes only the
rows that are new or whose tag changed, with the number of the round, and a row's tag is that of its last round. Parts with
tags are put together every ``PARTS`` rounds. Rows whose tag changes beyond saturation go around again, as far as the
algebra allows.

Schedulers decide which of the new rows go on: all (lfp), those of the latest round (dfs), all of the greatest weight (a-star), or the n
heaviest (beam); the others wait. At a fixpoint all schedulers have the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.evaluate import Evaluator
from ..plans.normal import FlatRule
from ..plans.syntax import Atom
from ..storage import Stored, written
from ..types import SPARK
from .tags import TAG

PARTS = 8
ROUND, GOES = "__round", "__goes"


@dataclass
class Options:
    """How far and in which order to go."""

    limit: int | None = None
    scheduler: str = "lfp"
    beam: int = 3
    stop_at_goal: bool = False
    goals: set[str] = field(default_factory=set)
    #: Told of each round, if there is a monitor.
    tell: Callable[[str, dict], None] | None = None


@dataclass
class Growing:
    """A relation of the stratum while it grows."""

    stored: Stored
    now: DataFrame | None = None
    delta: DataFrame | None = None
    before: DataFrame | None = None
    pending: DataFrame | None = None


def empty(spark: SparkSession, kinds: list[str], tag: str | None) -> DataFrame:
    schema = ", ".join([*[f"c{k} {SPARK[t].simpleString()}" for k, t in enumerate(kinds)], *([f"{TAG} {tag}"] if tag else [])])
    return spark.createDataFrame([], schema or "c0 boolean")


def fixpoint(
    evaluator: Evaluator,
    names: list[str],
    rules: list[FlatRule],
    kinds: dict[str, list[str]],
    base: dict[str, DataFrame],
    outside: Callable[[str], tuple[DataFrame, list[str]] | None],
    options: Options,
    hints: Callable[[FlatRule], dict],
) -> tuple[dict[str, DataFrame], int]:
    """The relations of a stratum, and the number of rounds."""
    spark, algebra = evaluator.spark, evaluator.algebra
    tag = algebra.type
    columns = {n: [f"c{k}" for k in range(len(kinds[n]))] or ["c0"] for n in names}
    grown = {n: Growing(Stored(spark, "stratum")) for n in names}
    recursive = [(r, [k for k, x in enumerate(r.body) if isinstance(x, Atom) and x.pred in names]) for r in rules]

    def relation(at: int | None) -> Callable[[int, str], tuple[DataFrame, list[str]] | None]:
        def rel(k: int, name: str) -> tuple[DataFrame, list[str]] | None:
            if name not in grown:
                return outside(name)
            g = grown[name]
            found = g.now if at is None or k > at else g.delta if k == at else g.before
            return (found if found is not None else empty(spark, kinds[name], tag)), kinds[name]

        return rel

    def derived(round_: int) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for rule, places in recursive:
            if round_ == 0 and places or round_ > 0 and not places:
                continue
            for at in places or [None]:
                if at is not None and grown[rule.body[at].pred].delta is None:
                    continue
                made = evaluator.rule(rule, relation(at), kinds[rule.head.pred], {at} if at is not None else None, hints(rule))
                out[rule.head.pred] = made if rule.head.pred not in out else out[rule.head.pred].unionByName(made)
        return out

    round_ = 0
    while True:
        found = derived(round_)
        if round_ == 0:
            for n in names:
                if n in base:
                    found[n] = base[n] if n not in found else base[n].unionByName(found[n])
        for n in names:
            g = grown[n]
            fresh = evaluator.merged_rows(found[n], columns[n]) if n in found else None
            g.before, g.delta = g.now, None
            if fresh is None and g.pending is None:
                continue
            _advance(evaluator, g, fresh, columns[n], round_, options)
        if options.tell:
            options.tell("round", {"stratum": tuple(names), "round": round_, "rows": {n: g.delta.count() if g.delta is not None else 0 for n, g in grown.items()}})
        done = all(g.delta is None for g in grown.values())
        goal = options.stop_at_goal and options.goals and options.goals <= set(names) and all(grown[x].now is not None for x in options.goals)
        if done or goal or options.limit is not None and round_ >= options.limit or not any(p for _, p in recursive):
            break
        round_ += 1
    return {n: g.now if g.now is not None else empty(spark, kinds[n], tag) for n, g in grown.items()}, round_


def _advance(evaluator: Evaluator, g: Growing, fresh: DataFrame | None, columns: list[str], round_: int, options: Options) -> None:
    """Merge what is new into a relation, and set what goes on to the next round."""
    algebra = evaluator.algebra
    if options.scheduler != "lfp":
        fresh = _scheduled(evaluator, g, fresh, columns, round_, options)
        if fresh is None:
            return
    if not algebra.type:
        if g.now is not None:
            fresh = fresh.join(g.now, columns, "left_anti")
        part = g.stored.add(fresh)
        if part.isEmpty():
            g.stored.paths.pop()
            return
        g.delta, g.now = part, g.stored.all()
        return
    kept = F.lit(True)
    if g.now is None:
        part = fresh.select(*columns, TAG, F.lit(True).alias(GOES))
    else:
        old = g.now.withColumnRenamed(TAG, "__old")
        merged = F.when(F.col("__old").isNull(), F.col(TAG)).otherwise(algebra.plus(F.col("__old"), F.col(TAG)))
        both = fresh.join(old, columns, "left").withColumn("__merged", merged)
        changed = F.col("__old").isNull() | ~algebra.saturated(F.col("__old"), F.col("__merged"))
        goes = changed if algebra.again else F.col("__old").isNull()
        part, kept = both.select(*columns, F.col("__merged").alias(TAG), goes.alias(GOES), changed.alias("__changed")), F.col("__changed")
    part = g.stored.add(part.where(kept).select(*columns, TAG, GOES, F.lit(round_).alias(ROUND)))
    if part.isEmpty():
        g.stored.paths.pop()
        return
    g.now = _latest(g.stored, columns)
    if len(g.stored.paths) > PARTS:
        whole = Stored(evaluator.spark, g.stored.name)
        whole.add(g.now.select(*columns, TAG, F.lit(False).alias(GOES), F.lit(round_).alias(ROUND)))
        g.stored, g.now = whole, _latest(whole, columns)
    delta = part.where(GOES).select(*columns, TAG)
    g.delta = delta if algebra.again or not delta.isEmpty() else None


def _latest(stored: Stored, columns: list[str]) -> DataFrame:
    """Each row with the tag of its last round."""
    if len(stored.paths) == 1:
        return stored.all().select(*columns, TAG)
    return stored.all().groupBy(*columns).agg(F.max_by(TAG, ROUND).alias(TAG))


def _scheduled(evaluator: Evaluator, g: Growing, fresh: DataFrame | None, columns: list[str], round_: int, options: Options) -> DataFrame | None:
    """The rows that are next in turn; the others wait."""
    algebra = evaluator.algebra
    waiting = g.pending
    if fresh is not None:
        fresh = fresh.withColumn("__seq", F.lit(round_))
        waiting = fresh if waiting is None else waiting.unionByName(fresh)
    if g.now is not None:
        if algebra.type:  # what is saturated by now need not wait
            old = g.now.withColumnRenamed(TAG, "__old")
            joined = waiting.join(old, columns, "left")
            waiting = joined.where(F.col("__old").isNull() | ~algebra.saturated(F.col("__old"), algebra.plus(F.coalesce("__old", TAG), F.col(TAG)))).drop("__old") if algebra.again else joined.drop("__old")
        else:
            waiting = waiting.join(g.now, columns, "left_anti")
    keys = [F.max("__seq").alias("__seq")] + ([algebra.sum(F.col(TAG)).alias(TAG)] if algebra.type else [])
    waiting = written(waiting.groupBy(*columns).agg(*keys), "waiting")
    weight = algebra.weight(F.col(TAG)) if algebra.type else F.lit(1.0)
    if options.scheduler == "beam":
        chosen = written(waiting.orderBy(weight.desc(), *columns).limit(options.beam), "chosen")
        if chosen.isEmpty():
            g.pending = None
            return None
        g.pending = waiting.join(chosen.select(*columns), columns, "left_anti")
        return chosen.drop("__seq")
    key = F.col("__seq") if options.scheduler == "dfs" else weight
    most = waiting.agg(F.max(key)).first()[0]  # one number
    if most is None:
        g.pending = None
        return None
    g.pending = waiting.where(key != F.lit(most))
    return waiting.where(key == F.lit(most)).drop("__seq")
