"""Exact de-duplication by content-defined chunk recipes; DataFrame operations only.

Texts count as equal when they are identical after each run of ASCII white space became one space. A text is cut
after every word whose hash is 0 modulo ``CHUNK_WORDS``, so equal passages give equal chunks wherever they stand.
Words of over ``LONG_WORD`` characters are also cut inside, after each character at which the hash of the last
``REACH`` characters is 0 modulo ``CHUNK_CHARS``, so texts without spaces are cut by their content too.
The marks for the cuts are escaped, so the list of chunks determines the text.

Each chunk gets its 64-bit hash as identifier. Identifiers are verified: the distinct chunks are grouped with their
whole text once (combined map-side), and a hash with two texts is a conflict. Documents then compare by their ordered
identifier lists, a few bytes a chunk: the texts of long documents don't move again. Documents that hold a
conflicting identifier also compare by the SHA-256 of their text. Recipes that a large share of all rows have are met by
broadcast (``hot_join``), so a large group fills no task.

Defined cases: null text is empty text; empty texts equal each other; the smallest id of a group stays (null ids
come last, and all rows that share the staying id stay); repeated rows count in group_size; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, hot_join, table, text_of, written

CHUNK_WORDS, LONG_WORD, CHUNK_CHARS, REACH = 64, 2048, 512, 8
_ESC, _ESCAPED, _CUT = "\u0001", "\u0001\u0002", "\u0001\u0003"


def normalised(text: Column) -> Column:
    """The text with one space for each run of ASCII white space."""
    return F.regexp_replace(text, SPACE, " ")


def chunks(norm: Column, chunk_words: int = CHUNK_WORDS) -> Column:
    """The chunks of a normalised text, in order; each but the last ends with the cut mark."""
    escaped = F.replace(norm, F.lit(_ESC), F.lit(_ESCAPED))

    def cut_inside(chars: Column) -> Column:
        before = lambda i: [F.coalesce(F.get(chars, i - k), F.lit("")) for k in range(REACH)]
        return F.array_join(F.transform(chars, lambda c, i: F.when(F.pmod(F.xxhash64(*before(i)), F.lit(CHUNK_CHARS)) == 0, F.concat(c, F.lit(_CUT))).otherwise(c)), "")

    def marked(word: Column) -> Column:
        # the array of one array binds the characters to a name, so that they are taken apart once
        chars = F.array(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)))
        inside = F.when(F.length(word) > LONG_WORD, F.get(F.transform(chars, cut_inside), 0)).otherwise(word)
        return F.when(F.pmod(F.xxhash64(word), F.lit(chunk_words)) == 0, F.concat(inside, F.lit(_CUT))).otherwise(inside)

    return F.split(F.array_join(F.transform(F.split(escaped, " "), marked), " "), f"(?<={_CUT})")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_chunks."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_of(text_col)).alias("norm"))
    cut_up = norm.select("id", F.sha2("norm", 256).alias("sha"), chunks(F.col("norm"), chunk_words).alias("chunk"))
    rows = written(cut_up.select("id", "sha", F.transform("chunk", lambda c: F.xxhash64(c)).alias("recipe")), "dedup-recipes")

    pieces = norm.select(F.explode(chunks(F.col("norm"), chunk_words)).alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")
    conflicts = pieces.distinct().groupBy("h").count().where("count > 1").select("h")
    conflicts = written(conflicts, "dedup-conflicts")
    if conflicts.isEmpty():
        rows = rows.withColumn("also", F.lit(""))
    else:
        hit = rows.select("id", F.explode("recipe").alias("h")).join(conflicts, "h", "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
        rows = rows.join(hit, "id", "left").select("id", "sha", "recipe", F.when(F.col("hit"), F.col("sha")).otherwise("").alias("also"))

    groups = rows.groupBy("recipe", "also").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = hot_join(rows, written(groups, "dedup-groups"), ["recipe", "also"], rows.count())
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows whose document stays, with their columns."""
    kept = exact_groups(docs, id_col=id_col, **options).where("kept").select(F.col(id_col).alias("__kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
