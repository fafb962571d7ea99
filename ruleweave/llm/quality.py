"""Quality rules with thresholds that follow the data; DataFrame operations only.

A document first fails on fixed base rules (under 50 words, or over half of its words in 3-word windows that the text
repeats). The others are measured, and each measure goes into a mergeable quantile sketch per language and source:
counts in exponentially spaced buckets, so a quantile has a relative error of at most ``ALPHA``, merging is adding
counts, and reruns agree. Thresholds are upper fences: third quartile + ``SPREAD`` times the interquartile range +
a tolerance per measure, so that a group without outliers rejects nothing, and up to a quarter of junk in a group
doesn't move its fence far. The threshold of a group of n documents is its own fence with weight n and that of its language
with weight ``STEADY``, and likewise a language's with that of everything; so small groups lean on what is known of larger ones,
without a step at any size. Documents are then filtered by a join with the thresholds on language and source.

Nothing is ordered or gathered by group but the sketches (some hundred buckets each), so a hot source costs no more
than others.

Defined cases: null or empty text has no words and fails; null language or source is a group of its own; repeated
rows each count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, table, text_of, word_array, written

ALPHA, SPREAD, STEADY = 0.01, 3.0, 100
_GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Per measure: what it divides, by what, and the tolerance above the fence.
MEASURES = {
    "symbols_per_word": ("n_symbols", "n_words", 0.1),
    "word_length": ("word_chars", "n_words", 2.0),
    "dup_lines": ("n_dup_lines", "n_lines", 0.5),
    "repeated_words": ("n_repeat_words", "n_words", 0.4),
}


def _counted(docs: DataFrame, id_col: str, text_col: str, group_cols: tuple[str, str]) -> DataFrame:
    """The base counts of every document."""
    text = text_of(text_col)
    no_space = F.translate(text, " \t\n\u000b\f\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        *[F.col(c).alias(f"g{k}") for k, c in enumerate(group_cols)],
        word_array(text).alias("w"),
        lines.alias("lines"),
        F.length(no_space).cast("long").alias("word_chars"),
        (F.length(no_space) - F.length(F.translate(no_space, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "id",
        "g0",
        "g1",
        "word_chars",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    # most texts repeat no window; only the others sort (hash, place) to find the places
    rows = rows.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    h = lambda i: F.get("sorted", i).getField("h")
    twice = F.filter(F.transform("sorted", lambda x, i: F.when((h(i - 1) == x["h"]) | (h(i + 1) == x["h"]), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("places", F.sort_array(twice))
    covered = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", "g0", "g1", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def _ratio(name: str) -> Column:
    over, under, _ = MEASURES[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def sketches(rows: DataFrame) -> DataFrame:
    """(g0, g1, measure, bucket, n): the sketches of all documents that passed the base rules. Bucket -9999 is 0."""
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _ratio(m).alias("x")) for m in MEASURES]))
    bucket = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.lit(math.log(_GAMMA)))).otherwise(F.lit(-9999)).cast("int")
    return rows.where("not base_failed").select("g0", "g1", measures.alias("m")).select("g0", "g1", "m.*").groupBy("g0", "g1", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group of merged sketches: the group, size, and the fence of each measure."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    running = Window.partitionBy(*by, "measure").orderBy("bucket")
    whole = Window.partitionBy(*by, "measure")
    value = F.when(F.col("bucket") == -9999, F.lit(0.0)).otherwise(F.lit(2.0) * F.pow(F.lit(_GAMMA), F.col("bucket")) / F.lit(_GAMMA + 1))
    ranked = merged.withColumn("upto", F.sum("n").over(running)).withColumn("total", F.sum("n").over(whole)).withColumn("value", value)
    at = lambda q: F.min(F.when(F.col("upto") > F.lit(q) * (F.col("total") - 1), F.col("value")))
    quartiles = ranked.groupBy(*by, "measure").agg(F.max("total").alias("size"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    tolerance = F.coalesce(*[F.when(F.col("measure") == m, F.lit(MEASURES[m][2])) for m in MEASURES])
    fence = F.col("q3") + F.lit(SPREAD) * (F.col("q3") - F.col("q1")) + tolerance
    return quartiles.groupBy(*by).agg(F.max("size").alias("size"), *[F.max(F.when(F.col("measure") == m, fence)).alias(m) for m in MEASURES])


def thresholds(sketch: DataFrame, steady: int = STEADY) -> DataFrame:
    """One row per language and source, with fences from its own, its language's and all documents."""
    own, language = _fences(sketch, ["g0", "g1"]).alias("o"), _fences(sketch, ["g0"]).alias("l")
    joined = own.join(language, F.col("o.g0").eqNullSafe(F.col("l.g0")))
    everything = _fences(sketch, []).first()  # one row: a number per measure

    def leaned(own: Column, size: Column, on: Column) -> Column:
        return (size * own + F.lit(steady) * on) / (size + F.lit(steady))

    pick = lambda m: leaned(F.col(f"o.{m}"), F.col("o.size"), leaned(F.col(f"l.{m}"), F.col("l.size"), F.lit(everything[m]).cast("double")))
    return joined.select("o.g0", "o.g1", *[pick(m).alias(f"most_{m}") for m in MEASURES])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), steady: int = STEADY) -> DataFrame:
    """One row per document: id, the counts, base_failed, kept, the measures and their thresholds."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(_counted(docs, id_col, text_col, group_cols).withColumn("base_failed", base), "quality-counts")
    limits = written(thresholds(written(sketches(rows), "quality-sketches"), steady), "quality-thresholds")
    joined = rows.alias("r").join(limits.alias("t"), F.col("r.g0").eqNullSafe(F.col("t.g0")) & F.col("r.g1").eqNullSafe(F.col("t.g1")), "left")
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.coalesce(_ratio(m) <= F.col(f"most_{m}"), F.lit(True))
    return joined.select(
        F.col("r.id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & within).alias("kept"),
        *[F.col(f"most_{m}") for m in MEASURES],
    )


def filtered(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows whose document the rules keep, with their columns."""
    kept = judged(docs, id_col=id_col, **options).where("kept").select(F.col(id_col).alias("__kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict for every document."""
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op2_sql() -> str:
    ratio = {m: f"CASE WHEN {under} > 0 THEN {over}::DOUBLE / {under} ELSE 0.0 END" for m, (over, under, _) in MEASURES.items()}
    measured = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {x} AS x FROM r WHERE NOT base_failed" for m, x in ratio.items())
    tolerance = "CASE measure " + " ".join(f"WHEN '{m}' THEN {t}" for m, (_, _, t) in MEASURES.items()) + " END"

    def fences(name: str, by: str) -> str:
        keys = by + ", " if by else ""
        within = f"PARTITION BY {keys}measure"
        wide = ", ".join(f"max(fence) FILTER (measure = '{m}') AS {m}" for m in MEASURES)
        return f"""{name} AS (
  SELECT {keys}max(size) AS size, {wide} FROM (
    SELECT {keys}measure, max(total) AS size,
           min(value) FILTER (upto > 0.75 * (total - 1)) + {SPREAD} * (min(value) FILTER (upto > 0.75 * (total - 1)) - min(value) FILTER (upto > 0.25 * (total - 1))) + {tolerance} AS fence
    FROM (SELECT {keys}measure, sum(n) OVER ({within} ORDER BY bucket) AS upto, sum(n) OVER ({within}) AS total,
                 CASE WHEN bucket = -9999 THEN 0.0 ELSE 2.0 * pow({_GAMMA!r}::DOUBLE, bucket) / {_GAMMA + 1!r}::DOUBLE END AS value
          FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM sketch GROUP BY {keys}measure, bucket)) GROUP BY {keys}measure) GROUP BY {by or '()'})"""

    pick = {m: f"((o.size * o.{m} + {STEADY} * ((l.size * l.{m} + {STEADY} * a.{m}) / (l.size + {STEADY}))) / (o.size + {STEADY}))" for m in MEASURES}
    within = " AND ".join(f"coalesce({ratio[m]} <= {pick[m]}, TRUE)" for m in MEASURES)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
p AS (SELECT doc_id, i, row_number() OVER () AS k, [words[i], words[i + 1], words[i + 2]] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM q, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
sketch AS (SELECT lang, source, measure, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / {math.log(_GAMMA)!r}::DOUBLE) AS INTEGER) ELSE -9999 END AS bucket, count(*) AS n
           FROM ({measured}) GROUP BY ALL),
{fences('own', 'lang, source')}, {fences('by_lang', 'lang')}, {fences('everything', '')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept
FROM r LEFT JOIN own o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source
LEFT JOIN by_lang l ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN everything a ON TRUE
"""


OP2_SQL = _op2_sql()
