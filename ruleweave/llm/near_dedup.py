"""Near-duplicates by SetSketch registers.

A document is its set of distinct k-word shingles (words between ASCII white space, A-Z lower-cased; with fewer words
the whole sequence is one shingle; without words the set is empty and links with nothing). Documents link when
100 * intersection >= 80 * union.

1. Each text gets a sketch: in each of ``REGISTERS`` registers the least of exponentially distributed hash values of
   its shingles, kept as its exponent to the base ``BASE``, truncated. The registers of a union are the maxima, and two
   registers are equal with about the probability of the Jaccard similarity. It also gets parity bits, 4 to 8 a shingle: bit h
   tells whether an odd number of shingles hash to h. The bits in which two documents differ are never more than the
   shingles that only one of them has, so these bits rule pairs out without ever ruling a link out.
2. Documents with equal sets (by a 128-bit fingerprint) are one class; only its least id goes on.
3. Registers are banded (``ROWS`` a band; a pair of similarity 0.8 shares none of the 32 bands with a probability
   of 3e-6). Within a band value each document is paired with the least id there: as many pairs as rows.
4. Pairs whose sizes, parity bits or jointly estimated similarity (maximum likelihood from the counts of larger, smaller and
   equal registers and the set sizes) can't reach the threshold go; the estimate may be ``SLACK`` (over seven standard
   deviations) too low. All others are confirmed on full sets.
5. Components of the confirmed links. In band values that still hold several components, members outside the largest one
   are paired with a changing member of it, again as many pairs as rows; these rounds go on while they find links and
   much is left.
6. Then all documents of different components that share a band value are compared by their parity bits, in blocks of
   about ``BLOCK`` documents on each side (fewer if they are long), members outside the largest component against all. Of the pairs that may link, each block
   gives the ``TRIES`` likeliest of each two components, to be confirmed on full sets; if those fail and there were more, this
   is done again with more, for such components only. So no link between components is lost, within a component no comparison is needed, and
   what moves is a byte a shingle at most, not texts.

The texts of documents that share a band value are dealt out once, for all confirmations. Links, components and
fingerprints stay distributed; every step is written to the shared folder. Classes, band values
and components that hold a large share of all rows are met by broadcast (``hot_join``), so they fill no task.

Defined cases: null or empty text has an empty set and stays alone; rows without id follow their class but don't
link; repeated rows are in one class and all rows of the least id stay; rows of one id with several texts link by each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TO_LOWER, discard, hash_spans, hot_join, map_arrow, mix64, slices, table, text_of, utf8_bytes, word_spans, written
from .components import components

REGISTERS, ROWS, BASE, RATE, TOP, SLACK = 160, 5, 1.02, 20.0, 4_000, 0.24
SIMILAR = 80
#: Rounds of changing partners go on while all pairs that are left are more than so many times the rows, up to a number.
LEFT, ROUNDS, BLOCK, TRIES = 4, 8, 2_048, 64
#: A document counts once in a block, and once more for each so many shingles.
HEAVY = 4_096
_STEP = 512


def _constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_XOR, _ODD = _constants(REGISTERS, 11)[:, None], _constants(REGISTERS, 23)[:, None] | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, offsets = utf8_bytes(column)
    data = TO_LOWER[data]
    begin, end, rows = word_spans(data, offsets)
    words = hash_spans(data, begin, end)
    windows = shingles(words, k)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        else:
            out.append(shingles(words[a:b], b - a)[:1] if b > a else words[:0])
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words."""
    total = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return mix64(total)


def registers(values: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), _STEP):
        np.minimum(least, (((values[None, k : k + _STEP] ^ _XOR) * _ODD)).min(axis=1), out=least)
    share = (least.astype(np.float64) + 1) / 2.0**64
    return np.clip(np.floor(1 - np.log(-np.log1p(-np.minimum(share, 1 - 1e-16)) / RATE) / np.log(BASE)), 0, TOP).astype(np.uint16)


def parities(values: np.ndarray) -> np.ndarray:
    """The parity bits of a set of 64-bit hashes, packed in 64-bit words; their number is a power of two."""
    bits = max(64, 1 << (4 * len(values) - 1).bit_length()) if len(values) else 64
    odd = np.bincount((mix64(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """Parity bits (rows of words, in the last axis) of fewer bits."""
    while parity.shape[-1] > words:
        half = parity.shape[-1] // 2
        parity = parity[..., :half] ^ parity[..., half:]
    return parity


def may_link(differ: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of ``total`` elements together link if ``differ`` elements at least are in one of them only."""
    return (100 + SIMILAR) * differ <= (100 - SIMILAR) * total


def likely_similarity(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of the greatest joint likelihood, given in how many registers a's is larger or smaller."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = REGISTERS - larger - smaller
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = np.maximum(p(u - v * j), 1e-300), np.maximum(p(v - u * j), 1e-300)
        return larger * np.log(more) + smaller * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-300))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


SKETCH = ["id", "n", "f1", "f2", "bands", "registers", "odd"]


def _sketched(k: int):
    band = np.arange(REGISTERS // ROWS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            n = len(sets)
            kept, prints, odd = np.zeros((n, REGISTERS), np.uint16), np.zeros((n, 2), np.uint64), [b""] * n
            for i, s in enumerate(sets):
                if len(s):
                    kept[i], odd[i] = registers(s), parities(s).tobytes()
                    prints[i] = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + np.uint64(0x14057B7EF767814F)))
            keys = np.zeros((n, len(band)), np.uint64)
            for r in range(ROWS):
                keys = keys * np.uint64(0x9E3779B97F4A7C15) + kept[:, r::ROWS]
            keys = mix64(keys * np.uint64(0xC2B2AE3D27D4EB4F) + band[None, :])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(band), pa.int32()), pa.array(keys.view(np.int64).reshape(-1)))
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 2 * REGISTERS).astype(np.int32)), pa.py_buffer(kept.tobytes())])
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), lists, raw, pa.array(odd, pa.binary())], SKETCH)

    return run


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may reach the threshold, by their parity bits and by the estimate."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n_a, n_b = (np.asarray(batch.column(c)).astype(np.int64) for c in ("na", "nb"))
        a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("oa", "ob"))
        words = [min(len(x), len(y)) for x, y in zip(a, b, strict=True)]
        differ = np.array([int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum()) for x, y, w in zip(a, b, words, strict=True)])
        at = np.flatnonzero(may_link(differ, n_a + n_b))
        a, b = (np.frombuffer(utf8_bytes(batch.column(c))[0].tobytes(), np.uint16).reshape(-1, REGISTERS)[at] for c in ("ra", "rb"))
        found = likely_similarity((a > b).sum(axis=1), (a < b).sum(axis=1), n_a[at].astype(np.float64), n_b[at].astype(np.float64))
        yield batch.take(pa.array(at[found >= SIMILAR / 100 - SLACK])).select(["a", "b"])


def _confirmed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "ta"):
                left, right = shingle_sets(part.column("ta"), k), shingle_sets(part.column("tb"), k)
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)])
                union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)]) - common
                yield part.filter(pa.array((100 * common >= SIMILAR * union) & (common > 0))).select(["a", "b"])

    return run


def _confirm(likely: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Those of the pairs (a, b), a written table, that link on full sets."""
    kind = likely.schema["a"].dataType.simpleString()
    needed = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct()
    texts = written(texts.join(needed, "id", "left_semi"), "near-texts")
    one, two = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    both = likely.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    links = written(map_arrow(both, _confirmed(k), f"a {kind}, b {kind}").distinct(), "near-links")
    discard(texts)
    return links


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    kind = reps.schema["id"].dataType.simpleString()
    names = {"id": "", "n": "n", "registers": "r", "odd": "o"}
    one, two = (reps.select(*[F.col(x).alias(y + c) for x, y in names.items()]) for c in "ab")
    sized = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb"))
    likely = written(map_arrow(sized.select("a", "b", "na", "nb", "ra", "rb", "oa", "ob"), _likely, f"a {kind}, b {kind}"), "near-likely")
    links = _confirm(likely, texts, k)
    discard(likely)
    return links


def _block_pairs(tries: int):
    """Pairs of documents of different components that may link, within blocks; rows are ordered by block."""

    def solve(block: pa.Table) -> pa.RecordBatch | None:
        side = np.asarray(block.column("side")) == 0
        if side.all() or not side.any():
            return None
        ids, component, n = block.column("id").combine_chunks(), np.asarray(block.column("component").combine_chunks().dictionary_encode().indices), np.asarray(block.column("n"))
        bits = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("odd").combine_chunks()]
        words = np.array([len(x) for x in bits])
        mine, theirs = {}, {}
        for w in np.unique(words).tolist():
            for of, which in ((mine, side), (theirs, ~side)):
                if len(rows := np.flatnonzero(which & (words == w))):
                    of[w] = rows, np.stack([bits[r] for r in rows.tolist()])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w, (rows, own) in mine.items():
            for v in (w // 2, w, 2 * w):  # sizes of links are within a quarter
                if v not in theirs:
                    continue
                others, other = theirs[v]
                least = min(v, w)
                one, two = folded(own, least), folded(other, least)
                for k, r in enumerate(rows.tolist()):
                    total = n[others] + n[r]
                    differ = np.bitwise_count(two ^ one[k]).sum(axis=1, dtype=np.int64)
                    hit = np.flatnonzero(may_link(differ, total) & (component[others] != component[r]))
                    if len(hit):
                        found.append((np.full(len(hit), r), others[hit], differ[hit] / total[hit]))
        if not found:
            return None
        a, b, far = (np.concatenate(x) for x in zip(*found, strict=True))
        low, high = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
        order = np.lexsort((far, high, low))
        a, b, low, high = a[order], b[order], low[order], high[order]
        new = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        sizes = np.diff(np.append(new, len(a)))
        rank = np.arange(len(a)) - np.repeat(new, sizes)
        keep = np.flatnonzero(rank < tries)
        more = np.repeat(sizes > tries, sizes)[keep]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a[keep])), ids.take(pa.array(b[keep])), pa.array(more)], ["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = pa.Table.from_batches([batch])
            held = block if held is None else pa.concat_tables([held, block])
            keys = np.stack([np.asarray(held.column(c)) for c in ("band", "mine", "theirs")])
            begin = 0
            for cut in (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist():
                if (found := solve(held.slice(begin, cut - begin))) is not None:
                    yield found
                begin = cut
            held = held.slice(begin)
        if held is not None and (found := solve(held)) is not None:
            yield found

    return run


def _cross_pairs(placed: DataFrame, mixed: DataFrame, n_rows: int, reps: DataFrame, tries: int) -> DataFrame:
    """Pairs (a, b) of different components that share a band value and may link, the likeliest ``tries`` of each two
    components in a block; more: there are others."""
    kind = reps.schema["id"].dataType.simpleString()
    rows = hot_join(placed.select("band", "id", "component"), mixed.select("band", "major", F.col("n").alias("rows"), "weight", "minor_weight"), ["band"], n_rows, "inner")
    # bits are met once a document, with all its band values; only after that is it dealt to its blocks
    rows = rows.groupBy("id", "component").agg(F.collect_list(F.struct("band", "major", "weight", "minor_weight")).alias("bands"))
    rows = rows.join(reps.select("id", "n", "odd"), "id").select("id", "component", "n", "odd", F.explode("bands").alias("in")).select("id", "component", "n", "odd", "in.*")
    n_mine, n_theirs = F.ceil(F.col("minor_weight") / BLOCK), F.ceil(F.col("weight") / BLOCK)
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), n))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    places = lambda side, mine, theirs: F.transform(mine, lambda m: F.transform(theirs, lambda t: F.struct(F.lit(side).alias("side"), m.alias("mine"), t.alias("theirs"))))
    mine, theirs = F.flatten(places(0, own(n_mine), every(n_theirs))), F.flatten(places(1, every(n_mine), own(n_theirs)))
    dealt = rows.select("band", "id", "component", "n", "odd", F.explode(F.when(F.col("component") != F.col("major"), F.concat(mine, theirs)).otherwise(theirs)).alias("at"))
    dealt = dealt.select("band", "at.mine", "at.theirs", "at.side", "id", "component", "n", "odd")
    blocks = dealt.repartition("band", "mine", "theirs").sortWithinPartitions("band", "mine", "theirs")
    found = map_arrow(blocks, _block_pairs(tries), f"a {kind}, b {kind}, more boolean")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "more")
    return written(pairs.groupBy("a", "b").agg(F.max("more").alias("more")), "near-cross")


def near_groups(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = written(map_arrow(texts, _sketched(k), f"id {kind}, n bigint, f1 bigint, f2 bigint, bands array<bigint>, registers binary, odd binary"), "near-sketches")
    n_docs, key = rows.count(), ["f1", "f2", "n"]
    classes = rows.where("n > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    classes = written(classes, "near-classes")
    copies = hot_join(rows.where("n > 0").select("id", *key), classes, key, n_docs, "inner").where("id <> rep").select("id", *key).distinct()
    banded = rows.where("n > 0 and id is not null").select("id", *key, "bands").join(copies, ["id", *key], "left_anti").select("id", "n", "bands").distinct()

    bands = banded.select("id", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min(F.struct("id", "n")).alias("least"), F.max("id").alias("last"), F.count(F.lit(1)).alias("rows"))
    shared = written(shared.where("least.id <> last").select("band", F.col("least.id").alias("first"), F.col("least.n").alias("first_n"), "rows"), "near-shared")
    together = written(hot_join(bands, shared, ["band"], n_docs * (REGISTERS // ROWS), "inner").select("band", "id", "n", "first", "first_n"), "near-bands")
    discard(shared)
    reps = written(rows.select("id", "n", "registers", "odd").join(together.select("id").distinct(), "id", "left_semi"), "near-registers")
    # all texts move once, and only those that share a band value are read again
    texts = written(texts.join(together.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"), "near-shared-texts")
    stars = together.where("id <> first").where(100 * F.least("n", "first_n") >= SIMILAR * F.greatest("n", "first_n")).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = _links(stars, reps, texts, k)
    found = components(links)

    # what is in one band value but in several components
    n_rows, round_, asking = together.count(), 0, True

    def split(among: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
        placed = together.join(found, together["id"] == found["node"], "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
        if among is not None:
            placed = placed.join(among, "component", "left_semi")
        drawn = F.struct(F.xxhash64("id", F.lit(round_)).alias("k"), F.col("id").alias("id"))
        parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("drawn"), F.sum(1 + F.floor(F.col("n") / HEAVY)).alias("weight"))
        major = F.max_by(F.struct("component", "drawn", "weight"), F.struct("n", "component"))
        mixed = parts.groupBy("band").agg(major.alias("major"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("weight").alias("weight"))
        mixed = mixed.where(F.col("kinds") > 1 if among is not None else "kinds > 1 and n > 2").select("band", "n", "most", F.col("major.component").alias("major"), F.col("major.drawn.id").alias("drawn"), "weight", (F.col("weight") - F.col("major.weight")).alias("minor_weight"))
        mixed = written(mixed, "near-mixed")
        return placed, mixed, mixed.agg(F.sum((F.col("n") - F.col("most")) * F.col("n"))).first()[0] or 0

    while True:
        placed, mixed, pairs = split()
        if pairs <= LEFT * n_rows or round_ == ROUNDS or not asking:
            break
        minor = hot_join(placed.select("band", "id", "component"), mixed.select("band", "major", "drawn", F.col("n").alias("rows")), ["band"], n_rows, "inner").where("component <> major")
        minor = written(minor.select(F.least("id", "drawn").alias("a"), F.greatest("id", "drawn").alias("b")).distinct(), "near-drawn")
        more, tried = _links(minor, reps, texts, k), minor.count()
        links, n_more = links.union(more), more.count()
        found = components(links) if n_more else found
        discard(minor, mixed)
        round_, asking = round_ + 1, 20 * n_more >= tried
    tries = TRIES
    while pairs:
        cross = _cross_pairs(placed, mixed, n_rows, reps, tries)
        links = links.union(_confirm(cross.select("a", "b"), texts, k))
        found = components(links)
        # two components of which the likeliest pairs don't link, but there were others
        if cross.where("more").isEmpty():
            break
        one, two = (found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        apart = cross.where("more").join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
        # all pairs of other components were compared, so only these components are compared again
        among = written(apart.select(F.explode(F.array("ca", "cb")).alias("component")).distinct(), "near-apart")
        if among.isEmpty():
            break
        placed, mixed, pairs = split(among)
        tries *= 8
    discard(together, reps, texts)

    classes = classes.join(found, classes["rep"] == found["node"], "left").select(*key, F.coalesce("component", "rep").alias("whole"), "rows")
    joined = hot_join(rows.select("id", *key), classes, key, n_docs).join(found, F.col("id") == F.col("node"), "left")
    component = F.coalesce("whole", "component", "id")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of one document of each component, with their columns."""
    kept = near_groups(docs, k, id_col=id_col, **options).where("kept").select(F.col(id_col).alias("__kept_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document on 2-word shingles: doc_id, n_shingles, component_id, kept."""
    return near_groups(table(spark, sf_dir, "documents"), k=2)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON d.doc_id = r.a LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id, n.n
"""
