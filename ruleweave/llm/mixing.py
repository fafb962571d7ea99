"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Sizes are word counts. Sources in code point order (null last) take the given weights in turn and share
``budget`` times all words; no target passes ``max_epochs`` times its source's words, and what is cut off
is shared by weight among the others until no target is above its bound.

The fixpoint of that reshare is closed-form: with sources ordered by bound / weight, those that stop at their
bound are a prefix, and the level of the others follows from running sums. Only the table of sources (one row
each) is ordered globally; documents never are.

A row is repeated floor(rate) times; for the fraction, rows in the order of a seeded key of id and text are taken
until the source's remaining words are reached, to the nearest row. That place is found by descent: sums by the first
digits of the key name the bucket in which it lies, sums by the next digits go on in that bucket, and so to a single key.
Equal rows (of one id and text) share a key; as many of them are taken as fit, by where they stand in the table. So
no source is ever ordered in one task however large it is, and reruns agree. Rows are never joined with each other:
each meets the one row of its source.

Defined cases: null text has size 0 and is taken as often as others; null source is a source of its own, after
all others; sources without words have target 0; null and repeated ids are told apart by their texts, equal rows by their
places, so targets are met with these too; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, word_count, written

WEIGHTS, BUDGET, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Hex digits of the key that name the bucket at each step of the descent.
DIGITS = (3, 6, 9)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = EPOCHS) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, target."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.select(
        "source",
        "source_size",
        F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
        (F.lit(float(max_epochs)) * F.col("source_size")).alias("bound"),
    )
    everything = Window.partitionBy()
    by_level = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = weighed.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") >= F.col("bound"))
    first = F.min_by("level", F.when(~F.col("stops"), F.col("bound") / F.col("weight"))).over(everything)
    return leveled.select(
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        F.when(F.col("stops") | first.isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), first * F.col("weight"))).alias("target"),
    )


def _boundary(sums: DataFrame, state: DataFrame, name: str) -> DataFrame:
    """(source, name, rest): in sums of size by source and ``name``, the first at which the running sum passes what is
    left for the source, and what is left before it. Sources that never pass it have no row."""
    joined = sums.alias("b").join(state.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    running = Window.partitionBy("b.source").orderBy(f"b.{name}")
    passed = joined.select("b.source", f"b.{name}", "b.size", "t.rest", F.sum("b.size").over(running).alias("upto")).where(F.col("upto") > F.col("rest"))
    found = passed.groupBy("source").agg(F.min(F.struct(name, (F.col("rest") - (F.col("upto") - F.col("size"))).alias("rest"))).alias("at"))
    return found.select("source", f"at.{name}", "at.rest")


def _cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, cut, last): the rows of a source to take once more are those of a key below ``cut``, and of this key up to place ``last``."""
    narrow, state = rows.select("source", "key", "size", "place"), targets.select("source", "rest")
    for n, digits in enumerate(DIGITS):
        if n:
            same = F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r.key").startswith(F.col("s.bucket"))
            narrow = narrow.alias("r").join(state.alias("s"), same).select("r.source", "r.key", "r.size", "r.place")
        sums = narrow.groupBy("source", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("size"))
        state = written(_boundary(sums, state, "bucket"), "mix-state")
    # the key itself, of few that are left, and how many of its equal rows fit
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r.key").startswith(F.col("s.bucket"))
    narrow = narrow.alias("r").join(state.alias("s"), same).select("r.source", "r.key", "r.size", "r.place")
    keys = narrow.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    at = _boundary(keys.select("source", "key", "size"), state, "key")
    one = F.col("k.size") / F.col("k.n")
    fit = F.greatest(F.lit(0), F.floor((F.col("rest") - one / 2) / one) + 1).cast("long")
    at = keys.alias("k").join(at.alias("a"), F.col("k.source").eqNullSafe(F.col("a.source")) & (F.col("k.key") == F.col("a.key")))
    at = written(at.select("k.source", "k.key", F.least(F.col("k.n"), fit).alias("size"), F.col("k.n").alias("n")), "mix-key")
    # which of the equal rows: first the partition of the table, then the place in it
    split = at.where("size > 0 and size < n").select("source", "key", (F.col("size") - 0.5).alias("rest"))
    equal = narrow.alias("r").join(split.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.key") == F.col("s.key")))
    equal = equal.select("r.source", "r.place", F.shiftright("r.place", 33).alias("part"))
    part = _boundary(equal.groupBy("source", "part").agg(F.count(F.lit(1)).alias("size")), split, "part")
    inside = equal.alias("r").join(part.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
    last = _boundary(inside.select("r.source", "r.place", F.lit(1).alias("size")), part, "place").select("source", F.col("place").alias("last"))
    chosen = F.when(F.col("a.size") == 0, F.lit(-1)).otherwise(F.coalesce("l.last", F.lit((1 << 63) - 1)))
    return written(at.alias("a").join(last.alias("l"), F.col("a.source").eqNullSafe(F.col("l.source")), "left").select("a.source", F.col("a.key").alias("cut"), chosen.cast("long").alias("last")), "mix-cuts")


def _dealt(
    docs: DataFrame, carried: list[str], id_col: str, text_col: str, source_col: str, weights: Sequence[float], budget: float, max_epochs: float, seed: str
) -> DataFrame:
    """Every row with id, source, size, source_size, target, copies and a struct ``doc`` of the carried columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    doc = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None)
    rows = docs.select(doc.alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"))
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "mix-rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(rows, weights, budget, max_epochs).withColumn("whole", F.floor(rate))
    targets = written(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    cuts = _cuts(rows, targets)
    # no cut: what is left takes all rows, or there is nothing to take
    whole = targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    whole = whole.select("t.source", "t.source_size", "t.target", "t.whole", "t.rest", "c.cut", "c.last").alias("w")
    again = F.when(F.col("w.rest") <= 0, 0).when(F.col("w.cut").isNull(), 1).otherwise(((F.col("r.key") < F.col("w.cut")) | (F.col("r.key") == F.col("w.cut")) & (F.col("r.place") <= F.col("w.last"))).cast("int"))
    joined = rows.alias("r").join(whole, F.col("r.source").eqNullSafe(F.col("w.source")))
    return joined.select("r.doc", "r.id", "r.source", "r.size", "w.source_size", "w.target", (F.col("w.whole") + again.cast("long")).alias("copies"))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies (how often the mix takes it)."""
    dealt = _dealt(docs, [], id_col, text_col, source_col, weights, budget, max_epochs, seed)
    return dealt.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "copies")


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it; the columns stay as they are."""
    dealt = _dealt(docs, docs.columns, id_col, text_col, source_col, weights, budget, max_epochs, seed).where("copies > 0")
    return dealt.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken, copies."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
      FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, source, source_size, weight, FALSE AS stopped,
         1.5 * sum(source_size) OVER () * weight / sum(weight) OVER () AS target FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, now_stopped,
         CASE WHEN now_stopped THEN 2.0 * source_size
              ELSE (1.5 * sum(source_size) OVER () - sum(CASE WHEN now_stopped THEN 2.0 * source_size ELSE 0 END) OVER ())
                   * weight / sum(CASE WHEN now_stopped THEN 0 ELSE weight END) OVER () END
  FROM (SELECT *, stopped OR target >= 2.0 * source_size AS now_stopped FROM fill)
  WHERE round < (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, target,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
      FROM fill WHERE round = (SELECT max(round) FROM fill)),
r AS (SELECT d.*, t.source_size, t.target, t.whole,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2.0
               <= t.target - t.whole * t.source_size AND t.target - t.whole * t.source_size > 0 AS more
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN more THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
       CAST(whole + CASE WHEN more THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r
"""
