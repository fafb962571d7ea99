"""Token counts by a map-side two-tier lookup of pre-tokens.

Texts split at ASCII white space; no token of a word-level tokenizer crosses it (checked on samples of all kinds of letters
when the tokenizer is read), so a text's count is the sum over its pre-tokens. The first tier holds the frequent ones: of a
sample of about ``SAMPLE`` whole texts (all, if there are no more), every partition passes on its distinct words, at most
``FREQUENT`` of them, and the ``FREQUENT`` commonest with the lengths that the library gives them form a compact
hash table of fixed size that is broadcast. Then each worker looks up the words of its rows in that table, the
misses in its own cache (bounded, emptied when full), and encodes what is new with the library. No pre-token is
shuffled, and what the driver gathers doesn't grow with the corpus.

The result doesn't depend on the sample nor on what is in either tier: all texts are counted whole, and a word found
by its hash is compared with the stored bytes.

Defined cases: null text is empty and has 0 bytes and tokens; repeated rows each count; very long words are encoded as
they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_spans, map_arrow, slices, table, text_of, utf8_bytes, word_spans
from .hash_cache import Growing, HashTable, SpanStore

FREQUENT, SAMPLE, CACHE, LIMIT = 16_384, 4_000, 2_000_000, 2_048
#: Longer words take no part in the first tier.
LONGEST = 64


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8_bytes(column)
    begin, end, rows = word_spans(data, offsets)
    return data, begin, end, rows, hash_spans(data, begin, end)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The commonest words of a partition's part of the sample, with their counts."""
    kept: Counter[bytes] = Counter()
    for batch in slices(batches, "text"):
        data, begin, end, _, hashes = _words(batch.column("text"))
        short = np.flatnonzero(end - begin <= LONGEST)
        _, first, counts = np.unique(hashes[short], return_index=True, return_counts=True)
        raw = data.tobytes()
        for b, e, n in zip(begin[short[first]].tolist(), end[short[first]].tolist(), counts.tolist(), strict=True):
            kept[raw[b:e]] += n
    if kept:
        found = kept.most_common(FREQUENT)
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w, _ in found], "n": [n for _, n in found]})


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = FREQUENT, sample: int = SAMPLE) -> list[str]:
    """The commonest pre-tokens of a sample of the texts, at most ``most``."""
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.select(F.col(text_col).alias("text")).sample(share, 1) if share < 1 else docs.select(F.col(text_col).alias("text"))
    total: Counter[str] = Counter()
    for r in map_arrow(rows, _distinct, "word string, n bigint").collect():
        total[r["word"]] += r["n"]
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]]


class _Counter:
    """Counts of pre-tokens by the library, one a worker."""

    of: dict[str, _Counter] = {}

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            raise ValueError("SentencePiece models have tokens across white space; see sentencepiece_codec")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._check(path)
        self.cache, self.counts = SpanStore(CACHE), Growing(np.int64)

    def _check(self, path: str) -> None:
        """Raise unless the count of a text is the sum over its words."""
        count = lambda text: len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        samples = ["a", "the", "É", "漢", "7", "'s", "!", "'", "😀", "\u0301", "_"]
        alone = {x: count(x) for x in samples}
        for x, y in itertools.product(samples, samples):
            for space in (" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n "):
                if count(x + space + y) != alone[x] + alone[y]:
                    raise ValueError(f"{path}: tokens cross white space")
        if any(any(c in " \t\n\x0b\x0c\r" for c in t.content) or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: special tokens take white space in")

    @classmethod
    def get(cls, path: str) -> _Counter:
        if path not in cls.of:
            cls.of[path] = cls(path)
        return cls.of[path]

    def encoded(self, words: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(words), 2_000):
            out += [len(x) for x in self.tokenizer.encode_batch_fast(words[k : k + 2_000], add_special_tokens=False)]
        return np.array(out, np.int64)

    def missing(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Counts of words that the broadcast table doesn't have."""
        used, fresh, base = self.cache.numbers(data, begin, end, hashes)
        if not base:
            self.counts = Growing(np.int64)
        if len(fresh):
            raw = data.tobytes()
            self.counts.append(self.encoded([raw[b:e].decode() for b, e in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)]))
        return self.counts.all[used]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, most: int = FREQUENT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. ``path``: a ``tokenizers`` file that every worker has."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    words = frequent_words(docs, text_col, most)
    lengths = _Counter.get(path).encoded(words)
    joined = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w.encode()) for w in words])]).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(HashTable(hash_spans(joined, at[:-1], at[1:]), lengths, joined, at))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter, first_tier = _Counter.get(path), shared.value
        for batch in slices(batches, "text"):
            data, begin, end, rows, hashes = _words(batch.column("text"))
            n = first_tier.find(data, begin, end, hashes)
            left = np.flatnonzero(n < 0)
            if len(left):
                n[left] = counter.missing(data, begin[left], end[left], hashes[left])
            upto = np.concatenate([[0], np.cumsum(n)])
            total = upto[rows[1:]] - upto[rows[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total)], ["id", "n_tokens"])

    bytes_of = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = bytes_of.schema["id"].dataType.simpleString()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes = pa.compute.binary_length(batch.column("text")).cast(pa.int64())
            at = 0
            for part in counted(iter([batch])):
                yield pa.RecordBatch.from_arrays([part.column(0), sizes.slice(at, part.num_rows), part.column(1)], ["id", "n_bytes", "n_tokens"])
                at += part.num_rows

    found = map_arrow(bytes_of, both, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
