"""What the operators share: paths, the shared scratch folder, word patterns and Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, hot_join, release, scratch_path, ship, written  # noqa: F401

#: ASCII white space, and a word between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, as workers see it, and the path in it: local ones, and all that Arrow knows."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), uri


def text_of(column: str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words (0 for null) as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_bytes`` of ``column`` each, so that workers need bounded memory."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0))
        if not len(sizes):
            continue
        ends = np.searchsorted(np.cumsum(sizes), np.arange(1, sizes.sum() // max_bytes + 1) * max_bytes, side="left") + 1
        begin = 0
        for end in [*dict.fromkeys(int(x) for x in ends if x < len(sizes)), len(sizes)]:
            yield batch.slice(begin, end - begin)
            begin = end


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len + 1 offsets of its rows; null rows are empty."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


#: Byte classes: ASCII white space; A-Z to a-z.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end bytes of every word, and the len + 1 word offsets of the rows. Words end with their row."""
    word = ~IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = word[starts]
    begin = np.flatnonzero(first)
    # a word ends before the next space or at the next row's begin
    stop = np.flatnonzero(~word)
    bound = np.concatenate([stop, offsets[1:]])
    bound.sort()
    end = bound[np.searchsorted(bound, begin, side="right")]
    return begin, end, np.searchsorted(begin, offsets)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix64 = _mix
#: Two primes below 2^31, each with a base for the powers of the bytes' places.
_FIELDS = ((2_147_483_647, 1_365_098_427), (2_147_483_629, 1_791_310_453))
#: Longer spans would overflow the sums.
_LONGEST = 1 << 24
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, prime)) % np.uint64(prime)
        size += more
    return out


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: polynomials of the bytes in two prime fields and the length, from prefix sums.

    Distinct spans of n bytes share a hash with a probability of about n^2 / 2^62; where results depend on it, bytes are compared.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    n = len(data) + 1
    halves = []
    wide = data.astype(np.uint64) + np.uint64(1)
    for prime, base in _FIELDS:
        if prime not in _POWERS or len(_POWERS[prime][0]) < n:
            _POWERS[prime] = _powers(base, prime, n), _powers(pow(base, -1, prime), prime, n)
        power, inverse = _POWERS[prime]
        total = np.zeros(n, np.uint64)
        np.cumsum(wide * power[: n - 1], out=total[1:])
        halves.append((total[end] - total[begin]) % np.uint64(prime) * inverse[begin] % np.uint64(prime))
    length = (end - begin).astype(np.uint64)
    out = _mix((halves[0] | (halves[1] << np.uint64(32))) ^ (length * np.uint64(0x9E3779B97F4A7C15)))
    for k in np.flatnonzero(length > _LONGEST).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])


def spans_equal(one: np.ndarray, begin: np.ndarray, end: np.ndarray, two: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each span of ``one`` has the bytes of its span of ``two``."""
    sizes = end - begin
    same = sizes == stop - start
    at = np.flatnonzero(same & (sizes > 0))
    differ = one[gather(begin[at], sizes[at])] != two[gather(start[at], sizes[at])]
    if differ.any():
        same[at[np.searchsorted(np.cumsum(sizes[at]), np.flatnonzero(differ), side="right")]] = False
    return same
