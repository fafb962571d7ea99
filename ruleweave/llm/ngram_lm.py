"""Scores of texts by an n-gram model in Elias-Fano tries.

Tokens are words (between ASCII white space, A-Z lower-cased) and one end per text, which is also what comes before the
first word. The model interpolates trigrams, bigrams and unigrams with absolute discounting:

    p3(c | a b) = (n(abc) - D) / n(ab) + D * kinds(ab) / n(ab) * p2(c | b),   p2 likewise,   p1(c) = (n(c) + 0.5) / (N + 0.5 (V + 1))

D is once / (once + 2 * twice), by order, from how many n-grams of the whole corpus occur once and twice.

Learning counts every n-gram of the training texts. The vocabulary is written as sorted hashes with counts, in
``PARTS`` files by hash; a word's id is its place. Triples of ids are counted per batch, and go in compressed blocks to
shards by their first word. The words that would fill over a quarter of a shard are split over all shards by their second word too, so
no frequent word makes a hot shard. Each shard first adds up its triples, which gives the discounts of all; then it becomes one file:

    level 1: ids a, level 2: ids b of every a, level 3: ids c of every (a, b) -- each an Elias-Fano sequence, in which the ids of
    one context are relative to the last value of the context before it, so that the whole level ascends;
    pointers from each level to the next, Elias-Fano too;
    discounted probabilities and context weights, two bytes each, with a codebook of ``BOOK`` values, evenly spaced in
    logarithms, so that no value is off by more than a ``BOOK``-th of the range (a thousandth of a decade or so).

So the model is the same for any number of shards, but for those thousandths.

Scoring maps the files into memory. The distinct pairs and triples of a batch are sought level by level: the
pointers give the range of the context, its last value before gives the offset, and the value is the successor
in its bucket. Memory is the pages that queries touch, shared by the workers of a machine; at most ``OPEN`` files are mapped at a time.

Files are renamed into place when they are whole. Workers open them through Arrow's file systems; those that are not
local are read instead of mapped.

Defined cases: null text is empty and has one token, the end; repeated rows each count; words of any length
are one token; without training texts every token has p1 = 1; the query learns from rows without id and gives them a null
held_out; an empty table gives an empty result; other columns are ignored. The triples of one pair of words are in one
shard; they are added up per batch before they move.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete
from .common import TO_LOWER, hash_spans, map_arrow, mix64, scratch_path, slices, store, table, text_of, utf8_bytes, word_spans
from .elias_fano import EliasFano

PARTS, SHARD_TOKENS, BATCH, BOOK, OPEN = 64, 2_000_000, 3 << 20, 4_096, 512
END = np.int64(0x0E0D)
NONE, UNKNOWN = 0xFFFFFFFF, 0xFFFFFFFE
DISCOUNT = 0.75
_U = np.uint64


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signed hashes of all tokens, each text with an end before and after; the len + 1 offsets of the texts."""
    data, offsets = utf8_bytes(column)
    data = TO_LOWER[data]
    begin, end, rows = word_spans(data, offsets)
    n = len(rows) - 1
    out = np.full(len(begin) + 2 * n, END, np.int64)
    inner = np.ones(len(out), bool)
    at = rows + 2 * np.arange(n + 1)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[inner] = hash_spans(data, begin, end).view(np.int64)
    return out, at


def _part_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(_U) >> _U(58)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH):
        tokens, at = _tokens(batch.column("text"))
        keys, counts = np.unique(np.delete(tokens, at[:-1]), return_counts=True)
        yield pa.RecordBatch.from_pydict({"h": keys, "n": counts.astype(np.int64), "part": _part_of(keys).astype(np.int32)})


def _save(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, whole or not at all."""
    files, name = store(path)
    files.create_dir(name.rsplit("/", 1)[0])
    temporary = f"{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary, compression=None) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a))
    files.move(temporary, name)


def _open(path: str, kind: type) -> np.ndarray | None:
    """The array in a file, mapped if it is local; None if there is none."""
    files, name = store(path)
    if files.get_file_info(name).type == pa.fs.FileType.NotFound:
        return None
    if isinstance(files, pa.fs.LocalFileSystem):
        return np.memmap(name, kind, "r").view(np.ndarray)
    with files.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _remove(path: str) -> None:
    files, name = store(path)
    if files.get_file_info(name).type != pa.fs.FileType.NotFound:
        files.delete_file(name)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each key, of batches that are ordered by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if now is not None and keys[a] != now:
                yield now, held
                held = []
            now = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def _write_vocabulary(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches, "part"):
            h, n = (np.concatenate([np.asarray(r.column(c)) for r in rows]) for c in ("h", "n"))
            order = np.argsort(h)
            h, n = h[order], n[order]
            _save(f"{folder}/words-{part:02d}", [np.array([len(h)], np.int64), h, n])
            yield pa.RecordBatch.from_pydict({"part": [part], "words": [len(h)], "total": [int(n.sum())]})

    return run


def _hot_words(model: Model):
    """Ids and counts of the words that fill over a quarter of a shard, of the parts given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files.get(model)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                if model.base[p] < model.base[p + 1]:
                    n = files.part(p)[1]
                    at = np.flatnonzero(4 * n * model.shards > model.total)
                    yield pa.RecordBatch.from_pydict({"word": at + model.base[p], "n": n[at]})

    return run


@dataclass
class Model:
    """What describes a model; its files are in ``folder``."""

    folder: str
    total: int = 0
    words: int = 0
    base: np.ndarray = field(default_factory=lambda: np.zeros(PARTS + 1, np.int64))
    shards: int = 1
    discounts: tuple[float, float] = (DISCOUNT, DISCOUNT)
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def shard_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = mix64(a.astype(_U) + _U(1))
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, a), len(self.hot) - 1)
            key = np.where(self.hot[k] == a, mix64(key + b.astype(_U)), key)
        return (key % _U(self.shards)).astype(np.int64)


class Files:
    """The mapped files of a model, one set a worker."""

    of: dict[str, Files] = {}

    def __init__(self, model: Model) -> None:
        self.model = model
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.tries: dict[int, Trie | None] = {}

    @classmethod
    def get(cls, model: Model) -> Files:
        if model.folder not in cls.of:
            cls.of.clear()
            cls.of[model.folder] = cls(model)
        cls.of[model.folder].model = model
        return cls.of[model.folder]

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and counts of a part of the vocabulary."""
        if p not in self.parts:
            flat = _open(f"{self.model.folder}/words-{p:02d}", np.int64)
            n = int(flat[0])
            self.parts[p] = flat[1 : n + 1], flat[n + 1 : 2 * n + 1]
        return self.parts[p]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending ids."""
        cuts = np.searchsorted(ids, self.model.base)
        return np.concatenate([self.part(p)[1][ids[x:y] - self.model.base[p]] for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y])

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (UNKNOWN for others) and counts (0 for others) of tokens."""
        keys, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(keys), UNKNOWN, np.int64), np.zeros(len(keys), np.int64)
        part = _part_of(keys)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
        for p in range(PARTS):
            mine = order[cuts[p] : cuts[p + 1]]
            if not len(mine) or self.model.base[p] == self.model.base[p + 1]:
                continue
            h, n = self.part(p)
            at = np.minimum(np.searchsorted(h, keys[mine]), len(h) - 1)
            hit = h[at] == keys[mine]
            ids[mine[hit]] = at[hit] + self.model.base[p]
            counts[mine[hit]] = n[at[hit]]
        return ids[back], counts[back]

    def trie(self, shard: int) -> Trie | None:
        if shard in self.tries:
            self.tries[shard] = self.tries.pop(shard)  # the latest is last
        else:
            if len(self.tries) >= OPEN:
                del self.tries[next(iter(self.tries))]
            flat = _open(f"{self.model.folder}/shard-{shard:05d}", _U)
            self.tries[shard] = None if flat is None else Trie(flat)
        return self.tries[shard]


def _triples(model: Model):
    """Counted triples (a, b, next) of each batch, in compressed blocks per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, zip_ = Files.get(model), zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text", BATCH):
            tokens, at = _tokens(batch.column("text"))
            ids = files.ids(tokens)[0]
            a, b = ids[:-1], ids[1:]
            c = np.append(ids[2:], NONE)
            c[at[1:] - 2] = NONE  # after an end comes nothing
            inside = np.ones(len(a), bool)
            inside[at[1:-1] - 1] = False
            a, b, c = a[inside], b[inside], c[inside]
            shard = model.shard_of(a, b)
            order = np.lexsort((c, b, a, shard))
            shard, a, b, c = shard[order], a[order], b[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
            n = np.diff(np.append(new, len(a)))
            shard, a, b, c = shard[new], a[new], b[new], c[new]
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            blocks = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                flat = np.concatenate([np.diff(a[x:y], prepend=0), b[x:y], c[x:y], n[x:y]]).astype("<u4")
                blocks.append(zip_.compress(flat.tobytes()))
            yield pa.RecordBatch.from_pydict({"shard": shard[cuts[:-1]].astype(np.int32), "block": blocks})

    return run


def _coded(values: np.ndarray, size: int = BOOK) -> tuple[np.ndarray, np.ndarray]:
    """Two bytes per positive value, and the codebook of what they stand for: the logarithmic means of even cells."""
    if not len(values):
        return np.zeros(0, np.uint16), np.zeros(size)
    logs = np.log(values)
    low, high = logs.min(), logs.max()
    of = np.minimum(((logs - low) * (size / max(high - low, 1e-12))).astype(np.int64), size - 1)
    n = np.bincount(of, minlength=size)
    return of.astype(np.uint16), np.exp(np.bincount(of, logs, size) / np.maximum(n, 1))


def _codes_flat(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint16)]).view(_U)


def _relative(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """The values of each context plus the last value of the one before, so that all ascend; and what none reaches."""
    ends = np.append(starts[1:], len(values)) - 1
    last = np.cumsum(values[ends])
    shift = np.repeat(np.concatenate([[0], last[:-1]]), ends - starts + 1)
    out = values + shift
    return out, int(out[-1]) + 1 if len(out) else 1


def _discount(once: int, twice: int) -> float:
    return float(min(0.95, max(0.05, once / (once + 2 * twice)))) if once else DISCOUNT


def build_shard(path: str, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, counts_of_a, discounts: tuple[float, float]) -> None:
    """Write the trie of triples (distinct, sorted)."""
    pair = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    pair_n = np.add.reduceat(n, pair)
    first, second = a[pair], b[pair]
    word = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    kinds = np.diff(np.append(word, len(first)))
    words = first[word]
    whole = counts_of_a(words).astype(np.float64)
    two, three = discounts
    weight1 = two * kinds / whole  # hot words have theirs in the model
    alpha2 = (pair_n - two) / np.repeat(whole, kinds)
    real = c != NONE
    of_pair = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(a))))
    c3, n3, of_pair = c[real], n[real], of_pair[real]
    children = np.bincount(of_pair, minlength=len(pair))
    weight2 = np.where(children > 0, three * children / pair_n, 1.0)
    alpha3 = (n3 - three) / pair_n[of_pair]
    ids1 = EliasFano.pack(words, int(words[-1]) + 1)
    to2 = EliasFano.pack(np.append(word, len(first)), len(first) + 1)
    ids2 = EliasFano.pack(*_relative(second, word))
    upto = np.concatenate([[0], np.cumsum(children)])
    to3 = EliasFano.pack(upto, len(c3) + 1)
    starts = upto[:-1][children > 0]
    ids3 = EliasFano.pack(*_relative(c3, starts)) if len(c3) else EliasFano.pack(c3, 1)
    coded = [_coded(x) for x in (weight1, alpha2, weight2, alpha3)]
    sections = [ids1, to2, ids2, to3, ids3, *[_codes_flat(codes) for codes, _ in coded], *[book.view(_U) for _, book in coded]]
    head = np.concatenate([[len(sections)], np.cumsum([0, *[len(s) for s in sections]])]).astype(_U)
    _save(path, [head, *sections])


class Trie:
    """A shard's levels, mapped into memory."""

    def __init__(self, flat: np.ndarray) -> None:
        n = int(flat[0])
        at = flat[1 : n + 2].astype(np.int64) + n + 2
        parts = [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.ids1, self.to2, self.ids2, self.to3, self.ids3 = (EliasFano(p) for p in parts[:5])
        codes, books = [p.view(np.uint16) for p in parts[5:9]], [p.view(np.float64) for p in parts[9:13]]
        self.weight1, self.alpha2, self.weight2, self.alpha3 = zip(codes, books, strict=True)

    @staticmethod
    def value(coded: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        return coded[1][coded[0][at]]

    def words(self, a: np.ndarray) -> np.ndarray:
        """The nodes of first words, or -1."""
        return self.ids1.find(a, np.zeros(len(a), np.int64), np.full(len(a), self.ids1.n, np.int64))

    @staticmethod
    def _child(pointers: EliasFano, level: EliasFano, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The nodes of ``word`` below ``node``, or -1: successors in the range of the context, relative to what is before it."""
        begin, end = pointers.access(node), pointers.access(node + 1)
        shift = np.zeros(len(node), np.int64)
        later = np.flatnonzero((begin > 0) & (begin < end))
        shift[later] = level.access(begin[later] - 1)
        return level.find(word + shift, begin, end)

    def pairs(self, node: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._child(self.to2, self.ids2, node, b)

    def triples(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self._child(self.to3, self.ids3, node, c)


def _merge(model: Model):
    """Add up the triples of each shard and keep them in a file; how often n-grams occur, and the followers of hot words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip, zip_ = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for shard, rows in _groups(batches, "shard"):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for r in rows:
                for block in r.column("block"):
                    flat = np.frombuffer(unzip.decompress(block.as_py()), "<u4").reshape(4, -1)
                    for k in range(4):
                        columns[k].append(np.cumsum(flat[0], dtype=np.uint32) if k == 0 else flat[k])
            a, b, c, n = (np.concatenate(x) for x in columns)
            columns.clear()
            order = np.lexsort((c, b, a))
            a, b, c, n = (x[order].astype(np.int64) for x in (a, b, c, n))
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
            n = np.add.reduceat(n, new)
            a, b, c = a[new], b[new], c[new]
            raw = np.concatenate([np.diff(a, prepend=0), b, c, n]).astype("<u4")
            _save(f"{model.folder}/raw/{shard:05d}", [np.frombuffer(zip_.compress(raw.tobytes()), np.uint8)])
            pair = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            pair_n, n3 = np.add.reduceat(n, pair), n[c != NONE]
            hot, kinds = np.unique(a[pair][np.isin(a[pair], model.hot)], return_counts=True)
            rare = [int((x == k).sum()) for x in (pair_n, n3) for k in (1, 2)]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "rare": [rare], "hot": [hot], "kinds": [kinds]})

    return run


def _build(model: Model):
    """The tries of the shards given, from their triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        files, unzip = Files.get(model), zstandard.ZstdDecompressor()
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                packed, final = _open(f"{model.folder}/raw/{shard:05d}", np.uint8), f"{model.folder}/shard-{shard:05d}"
                if packed is not None:
                    raw = np.frombuffer(unzip.decompress(packed.tobytes()), "<u4").reshape(4, -1)
                    a, b, c, n = np.cumsum(raw[0], dtype=np.int64), *raw[1:].astype(np.int64)
                    build_shard(final, a, b, c, n, files.counts, model.discounts)
                    _remove(f"{model.folder}/raw/{shard:05d}")
                elif _open(final, _U) is None:  # else an attempt before this one was done
                    raise FileNotFoundError(final)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

    return run


def learn(texts: DataFrame, text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> Model:
    """A model of all texts; its files go to the shared folder."""
    spark = texts.sparkSession
    rows = texts.select(text_of(text_col).alias("text"))
    folder = scratch_path(spark, "ngrams")
    counted = map_arrow(rows, _count_words, "h bigint, n bigint, part int").groupBy("part", "h").agg(F.sum("n").alias("n"))
    by_part = counted.repartition(PARTS, "part").sortWithinPartitions("part")
    model = Model(folder)
    sizes = np.zeros(PARTS, np.int64)
    for p in map_arrow(by_part, _write_vocabulary(folder), "part bigint, words bigint, total bigint").collect():
        sizes[p["part"]] = p["words"]
        model.total += p["total"]
    model.words = int(sizes.sum())
    model.base = np.concatenate([[0], np.cumsum(sizes)])
    if not model.words:
        return model
    if model.words >= UNKNOWN:
        raise ValueError("ids have 32 bits")
    model.shards = max(1, -(-model.total // shard_tokens))
    hot: dict[int, int] = {}
    if model.shards > 1:  # at most four a shard
        hot = {r["word"]: r["n"] for r in map_arrow(spark.range(0, PARTS, 1, 8), _hot_words(model), "word bigint, n bigint").collect()}
    model.hot = np.array(sorted(hot), np.int64)
    blocks = map_arrow(rows, _triples(model), "shard int, block binary").repartitionById(model.shards, "shard").sortWithinPartitions("shard")
    merged = map_arrow(blocks, _merge(model), "shard int, rare array<bigint>, hot array<bigint>, kinds array<bigint>").collect()
    once2, twice2, once3, twice3 = np.sum([r["rare"] for r in merged], axis=0).tolist()
    model.discounts = _discount(once2, twice2), _discount(once3, twice3)
    kinds: dict[int, int] = {}
    for r in merged:
        for w, k in zip(r["hot"], r["kinds"], strict=True):
            kinds[w] = kinds.get(w, 0) + k
    model.hot_weight = np.array([model.discounts[0] * kinds.get(w, 0) / hot[w] for w in model.hot.tolist()])
    shards = spark.createDataFrame([(r["shard"],) for r in merged], "shard int").repartitionById(len(merged), F.expr(f"shard % {len(merged)}"))
    map_arrow(shards, _build(model), "shard int").collect()
    delete(spark, f"{folder}/raw")
    return model


def _by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard that occurs."""
    if not len(shards):
        return
    order = np.argsort(shards, kind="stable")
    sorted_ = shards[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shards)], strict=True):
        yield int(sorted_[x]), order[x:y]


def _score_batch(files: Files, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token (ends before the first word have no meaning): its count, and log10 of its probability."""
    model = files.model
    ids, counts = files.ids(tokens)
    p = (counts + 0.5) / (model.total + 0.5 * (model.words + 1))
    if not model.words:
        return counts, np.log10(p)
    known = ids != UNKNOWN
    # pairs: place i is (i - 1, i)
    inner = np.ones(len(ids), bool)
    inner[at[:-1]] = False
    place = np.flatnonzero(inner)
    a, b = ids[place - 1], ids[place]
    with_a = known[place - 1]
    place, a, b = place[with_a], a[with_a], b[with_a]
    keys, back = np.unique((a.astype(_U) << _U(32)) | b.astype(_U), return_inverse=True)
    ka, kb = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
    shard = model.shard_of(ka, kb)
    node, alpha, weight_a, weight = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys)), np.ones(len(keys))
    for s, mine in _by_shard(shard):
        trie = files.trie(s)
        if trie is None:
            continue
        words, of = np.unique(ka[mine], return_inverse=True)
        top = trie.words(words)
        weight_a[mine] = np.where(top >= 0, trie.value(trie.weight1, np.maximum(top, 0)), 1.0)[of]
        live = np.flatnonzero((top[of] >= 0) & (kb[mine] != UNKNOWN))
        found = trie.pairs(top[of][live], kb[mine[live]])
        hit = found >= 0
        at_, found = mine[live[hit]], found[hit]
        node[at_], alpha[at_], weight[at_] = found, trie.value(trie.alpha2, found), trie.value(trie.weight2, found)
    if len(model.hot):
        k = np.minimum(np.searchsorted(model.hot, ka), len(model.hot) - 1)
        weight_a = np.where(model.hot[k] == ka, model.hot_weight[k], weight_a)
    p[place] = alpha[back] + weight_a[back] * p[place]
    # triples: below the pair that ends at the place before
    pair_at = np.full(len(ids), -1, np.int64)
    pair_at[place] = back
    place = np.flatnonzero(inner)
    place = place[inner[place - 1]]
    before = pair_at[place - 1]
    ok = (before >= 0) & (node[np.maximum(before, 0)] >= 0)
    place, before = place[ok], before[ok]
    c = np.where(known[place], ids[place], NONE)
    p[place] *= weight[before]
    live = c != NONE
    place, before, c = place[live], before[live], c[live]
    keys, back = np.unique((before.astype(_U) << _U(32)) | c.astype(_U), return_inverse=True)
    kp, kc = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
    alpha = np.zeros(len(keys))
    for s, mine in _by_shard(shard[kp]):
        trie = files.trie(s)
        found = trie.triples(node[kp[mine]], kc[mine])
        hit = found >= 0
        alpha[mine[hit]] = trie.value(trie.alpha3, found[hit])
    p[place] += alpha[back]
    return counts, np.log10(p)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files.get(model)
        for batch in slices(batches, "text", BATCH):
            tokens, at = _tokens(batch.column("text"))
            counts, logs = _score_batch(files, tokens, at)
            base = np.log10((counts + 0.5) / (model.total + 0.5 * (model.words + 1)))
            known = (counts > 0).astype(np.int64)
            for x in (base, logs, known):
                x[at[:-1]] = 0
            sums = [np.add.reduceat(x, at[:-1]) if len(at) > 1 else x[:0] for x in (known, base, logs)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at) - 1), *[pa.array(x) for x in sums]], ["id", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    found = map_arrow(rows, run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.withColumnRenamed("id", id_col)


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those not held out: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    model = learn(docs.where(~F.coalesce(held_out, F.lit(False))))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
