"""Language identification by interpolated Kneser-Ney character models, one per language.

Text is lower-cased and cut into runs of letters; a model gives each letter, and the end of each run, a probability
from up to three letters before it in the run. Top-order counts are raw, lower orders count distinct left contexts,
and each order is discounted and interpolated with the next. A model keeps its probabilities and context
weights in arrays sorted by 64-bit hash. The language of a text is the one with the lowest cross-entropy per letter.

The models are classifiers fit on a bounded sample of labelled rows: about ``FIT`` texts per language, chosen by a hash
of the id. About ``CALIBRATE`` other texts per language (a ninth of those of the fit where there are few; languages of under
``FEW`` rows use all theirs for both) set the temperature that turns cross-entropies into a score, and the cross-entropy above
which a text is not accepted as its best language.

All counts, discounts and probabilities are those of the whole sample. Of the longest n-grams, a model then keeps the
``GRAMS`` most frequent, which bounds what is broadcast; the weights of their contexts are set anew, so that probabilities
still sum to one.

Every text is scored whole. Workers score each distinct run of letters once and keep it in a bounded cache.

Defined cases: text that is null or has no letter gives ``und`` with score 0; without labelled rows everything is ``und``;
repeated rows each count; the query doesn't learn from rows without id, and gives them a null held_out; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_spans, map_arrow, mix64, slices, table, utf8_bytes, word_spans
from .hash_cache import Growing, SpanStore

ORDER, FIT, CALIBRATE, FEW, GRAMS, CACHE = 4, 2_000, 300, 100, 100_000, 800_000
#: The share of a language's own texts that its acceptance threshold takes in.
ACCEPT = 0.995
PAD = "\u0002"


def runs_of_letters(column: pa.Array) -> pa.Array:
    """Lower-cased texts with one space for everything between letters."""
    return pa.compute.replace_substring_regex(pa.compute.utf8_lower(column.fill_null("")), r"\P{L}+", " ")


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words between pads, the places to predict, and the word of each place."""
    text = PAD * (ORDER - 1) + (PAD * ORDER).join(words) + PAD
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = points != ord(PAD)
    places = letter.copy()
    places[1:] |= letter[:-1]
    at = np.flatnonzero(places)
    return points, at, np.cumsum(~letter[at]) - ~letter[at]


_POINT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of sequences of code points, one column each, the last one first."""
    total = np.full(len(columns[0]), len(columns), np.uint64)
    for k, c in enumerate(columns):
        total = total + mix64(c.astype(np.uint64) + np.uint64(1)) * _POINT[k]
    return mix64(total)


class KneserNey:
    """One language: per order sorted hashes with log probabilities, and of contexts with log weights."""

    def __init__(self, grams: list[str], counts: np.ndarray, alphabet: int, most: int = GRAMS) -> None:
        points = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, ORDER).astype(np.int64)
        levels = [(points, counts.astype(np.float64))]
        for _ in range(ORDER - 1):
            shorter, n = np.unique(levels[-1][0][:, 1:], axis=0, return_counts=True)
            levels.append((shorter, n.astype(np.float64)))
        lower = None
        self.grams, self.contexts = [], []
        for points, n in reversed(levels):
            once, two = (n == 1).sum(), (n == 2).sum()
            discount = min(0.9, max(0.1, once / (once + 2 * two))) if once else 0.5
            _, of = np.unique(points[:, :-1], axis=0, return_inverse=True) if points.shape[1] > 1 else (None, np.zeros(len(points), np.int64))
            of = of.reshape(-1)
            total, kinds = np.bincount(of, n), np.bincount(of)
            weight = discount * kinds / total
            below = np.full(len(points), 1 / alphabet) if lower is None else np.exp(self._find(lower, _hashes(list(points[:, :0:-1].T))))
            keys, p = _hashes(list(points[:, ::-1].T)), (n - discount) / total[of] + weight[of] * below
            if points.shape[1] == ORDER and len(p) > most:
                keep = np.sort(np.argsort(-n, kind="stable")[:most])
                kept = np.bincount(of[keep], p[keep], len(total)), np.bincount(of[keep], below[keep], len(total))
                weight = (1 - kept[0]) / np.maximum(1 - kept[1], 1e-300)
                first = np.unique(of, return_index=True)[1]
                contexts, of = points[first], np.arange(len(first))
                keys, p = keys[keep], p[keep]
            else:
                contexts = points
            order = np.argsort(keys)
            lower = keys[order], np.log(p)[order]
            self.grams.append((lower[0], lower[1].astype(np.float32)))
            if points.shape[1] > 1:
                first = np.unique(of, return_index=True)[1]
                keys = _hashes(list(contexts[first][:, -2::-1].T))
                order = np.argsort(keys)
                self.contexts.append((keys[order], np.log(weight)[order].astype(np.float32)))
            else:
                self.unknown = float(np.log(weight[0] / alphabet))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at], np.nan)

    def score(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of places, given their hashes of each order and those of the contexts."""
        out, left = np.zeros(len(hashes[0])), np.arange(len(hashes[0]))
        for k in range(ORDER, 0, -1):
            found = self._find(self.grams[k - 1], hashes[k - 1][left])
            hit = ~np.isnan(found)
            out[left[hit]] += found[hit]
            left = left[~hit]
            if k > 1 and len(left):
                out[left] += np.nan_to_num(self._find(self.contexts[k - 2], contexts[k - 2][left]))
        out[left] += self.unknown
        return out


class Models:
    """All languages in order, with what turns cross-entropies into a score and a verdict."""

    def __init__(self, languages: dict[str, KneserNey]) -> None:
        self.names = sorted(languages)
        self.models = [languages[n] for n in self.names]
        self.temperature, self.limits = 0.1, np.full(len(self.names), np.inf)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages + 1): log probabilities per language, then the number of places."""
        points, at, word = _padded(words)
        shifted = [points[at - k] for k in range(ORDER)]
        hashes = [_hashes(shifted[:k]) for k in range(1, ORDER + 1)]
        contexts = [_hashes(shifted[1:k]) for k in range(2, ORDER + 1)]
        out = np.empty((len(words), len(self.models) + 1))
        for k, m in enumerate(self.models):
            out[:, k] = np.bincount(word, m.score(hashes, contexts), len(words))
        out[:, -1] = np.bincount(word, minlength=len(words))
        return out

    def cache(self) -> tuple[SpanStore, Growing]:
        """What ``entropies`` keeps between batches."""
        return SpanStore(CACHE), Growing(np.float32, (len(self.models) + 1,))

    def entropies(self, column: pa.Array, cache: tuple[SpanStore, Growing] | None = None) -> np.ndarray:
        """(texts, languages) cross-entropies per place; nan for texts without letters."""
        data, offsets = utf8_bytes(runs_of_letters(column))
        begin, end, rows = word_spans(data, offsets)
        if not len(begin):
            return np.full((len(column), len(self.models)), np.nan)
        known, scores = cache or self.cache()
        used, fresh, base = known.numbers(data, begin, end, hash_spans(data, begin, end))
        if not base:
            scores.n = 0
        if len(fresh):
            raw = data.tobytes()
            scores.append(self.word_scores([raw[b:e].decode() for b, e in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)]))
        upto = np.zeros((len(begin) + 1, len(self.models) + 1))
        np.cumsum(scores.all[used], axis=0, dtype=np.float64, out=upto[1:])
        total = upto[rows[1:]] - upto[rows[:-1]]
        with np.errstate(invalid="ignore", divide="ignore"):
            return -total[:, :-1] / total[:, -1:]

    def calibrate(self, entropies: np.ndarray, truth: np.ndarray) -> None:
        """Set the temperature with the least log loss, and the acceptance limit of each language."""
        if not len(truth):
            return
        gap = entropies - entropies.min(axis=1, keepdims=True)
        grid = np.geomspace(0.005, 2.0, 40)
        losses = [np.mean(np.log(np.exp(-gap / t).sum(axis=1)) + gap[np.arange(len(truth)), truth] / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])
        for k in range(len(self.names)):
            if (own := truth == k).any():
                self.limits[k] = 1.05 * np.quantile(entropies[own, k], ACCEPT)

    def decide(self, entropies: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is accepted as that language."""
        none = np.isnan(entropies).any(axis=1) if entropies.shape[1] else np.ones(len(entropies), bool)
        if not entropies.shape[1]:
            return ["und"] * len(entropies), np.zeros(len(entropies)), ~none
        safe = np.where(none[:, None], 0.0, entropies)
        best = safe.argmin(axis=1)
        gap = safe - safe.min(axis=1, keepdims=True)
        score = np.where(none, 0.0, 1 / np.exp(-gap / self.temperature).sum(axis=1))
        return [("und" if n else self.names[b]) for n, b in zip(none.tolist(), best.tolist(), strict=True)], score, ~none & (safe.min(axis=1) <= self.limits[best])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each slice."""
    for batch in slices(batches, "text"):
        langs = batch.column("lang")
        for lang in pa.compute.unique(langs).to_pylist():
            text = batch.filter(pa.compute.equal(langs, lang)).column("text")
            words, counts = np.unique(np.array(" ".join(runs_of_letters(text).to_pylist()).split(" "), object), return_counts=True)
            keep = words != ""
            words, counts = words[keep], counts[keep]
            if not len(words):
                continue
            points, at, word = _padded(words.tolist())
            grams = np.ascontiguousarray(np.stack([points[at - k] for k in range(ORDER - 1, -1, -1)], axis=1).astype("<u4"))
            names, of = np.unique(grams.view(f"<U{ORDER}").reshape(-1), return_inverse=True)
            n = np.bincount(of, counts[word]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(names), "gram": names.tolist(), "n": n})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT, calibrate: int = CALIBRATE, grams: int = GRAMS) -> Models:
    """Models from labelled rows; rows without text or language are left out."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Models({})
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def share(n: int, most: float) -> Column:
        """The share of a language's rows that gives about ``n`` of them, and ``most`` of them at most."""
        return F.element_at(F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0 if size < FEW else most, n / size))]), F.col("lang"))

    found = (
        map_arrow(rows.where(draw < share(per_language, 0.9)).select("lang", "text"), _count_grams, "lang string, gram string, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .orderBy("lang", "gram")
        .toArrow()
    )
    alphabet = len(set("".join(found["gram"].to_pylist()))) + 1
    models = {}
    for lang in sizes:
        own = found.filter(pa.compute.equal(found["lang"], lang))
        if own.num_rows:
            models[lang] = KneserNey(own["gram"].to_pylist(), np.asarray(own["n"]), alphabet, grams)
    fitted = Models(models)
    chosen = rows.where((1 - draw) <= share(calibrate, 0.1)).select("lang", "text")
    found = _scored(chosen, fitted, ["lang"]).select("lang", "entropies").toArrow()
    entropies = np.array(found["entropies"].to_pylist(), np.float64).reshape(found.num_rows, -1)
    known = np.array([x in models for x in found["lang"].to_pylist()], bool) & ~np.isnan(entropies).any(axis=1)
    truth = np.array([fitted.names.index(x) if x in models else 0 for x in found["lang"].to_pylist()], np.int64)
    fitted.calibrate(entropies[known], truth[known])
    return fitted


def _scored(rows: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        cache = models.cache()
        for batch in slices(batches, "text"):
            found = models.entropies(batch.column("text"), cache)
            langs, scores, accepted = models.decide(found)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(langs), pa.array(scores), pa.array(accepted), flat], [*keep, "lang_pred", "score", "accepted", "entropies"])

    return map_arrow(rows, score, ", ".join([*kinds, "lang_pred string, score double, accepted boolean, entropies array<double>"]))


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, accepted."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _scored(rows, models, ["id"]).select(F.col("id").alias(id_col), "lang_pred", "score", "accepted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score, accepted."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    models = fit(docs.where(~held_out))
    return identify(docs, models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
