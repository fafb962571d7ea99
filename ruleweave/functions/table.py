"""Foreign predicates: relations that are computed from bound arguments.

Each takes the bound columns and gives an array of structs, one for each row that holds, or a condition if all
arguments are bound. A predicate that gives tags returns them as probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import SPARK, TENSORS
from .scalar import Typed


@dataclass(frozen=True)
class Predicate:
    """``bound`` arguments come first. ``rows``: arrays of structs for the others; ``holds``: a condition; ``prob``: a probability."""

    bound: int
    free: tuple[str, ...] = ()
    rows: Callable[..., Column] | None = None
    holds: Callable[..., Column] | None = None
    prob: Callable[..., Column] | None = None
    #: Whether the rows of one call differ from each other.
    unique: bool = False
    #: Whether it is worth while to compute equal arguments once.
    once: bool = False
    #: Takes one row per call of a Python function instead: lists of tuples.
    udf: Callable | None = None


def _range(low: Typed, high: Typed) -> Column:
    last = high[0] - F.lit(1).cast(SPARK[high[1]])
    return F.when(low[0] < high[0], F.transform(F.sequence(low[0], F.when(low[0] < high[0], last).otherwise(low[0])), lambda i: F.struct(i.cast(SPARK[low[1]]).alias("c0")))).otherwise(F.array())


def _characters(s: Typed) -> Column:
    """Split at code points."""
    letters = F.filter(F.split(s[0], ""), lambda c: c != "")
    return F.transform(letters, lambda c, i: F.struct(i.cast("bigint").alias("c0"), c.alias("c1")))


def _byte_places(s: Typed) -> Column:
    n = F.octet_length(s[0])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n.cast("bigint") - 1, F.lit(0))), lambda i: F.struct(i.alias("c0")))).otherwise(F.array())


def _parts(s: Typed, separator: Typed) -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace(separator[0], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.transform(F.array_distinct(F.split(s[0], quoted)), lambda c: F.struct(c.alias("c0")))


def _found(s: Typed, part: Typed) -> Column:
    """Non-overlapping occurrences: byte places of their begins, and these plus their numbers of characters."""
    pieces = F.split(s[0], F.concat(F.lit("\\Q"), F.replace(part[0], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    step = F.octet_length(part[0]).cast("bigint")
    ends = F.transform(F.filter(pieces, lambda _, i: i < F.size(pieces) - 1), lambda p: F.octet_length(p).cast("bigint"))
    begins = F.transform(ends, lambda _, i: F.aggregate(F.slice(ends, 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x) + i * step)
    return F.when(step > 0, F.transform(begins, lambda b: F.struct(b.alias("c0"), (b + F.length(part[0])).alias("c1")))).otherwise(F.array())


#: Sigmoid shapes for soft comparisons, of the scaled difference.
SIGMOIDS: dict[str, Callable[[Column], Column]] = {
    "logistic": lambda x: 1 / (1 + F.exp(-x)),
    "reciprocal": lambda x: x / (1 + 2 * F.abs(x)) + 0.5,
    "cauchy": lambda x: F.atan(x) / F.lit(math.pi) + 0.5,
    "optimal": lambda x: F.when(x < -0.25, -1 / (16 * x)).when(x > 0.25, 1 - 1 / (16 * x)).otherwise(x + 0.5),
}


def soft_comparisons(shape: str = "logistic", beta: float = 1.0) -> dict[str, Predicate]:
    """Comparisons that hold with a probability: orders by the sigmoid of ``beta`` times the difference, equality by the
    steepness of the logistic one there, which is 1 where the operands are equal."""
    sigmoid = SIGMOIDS[shape]
    scaled = lambda a, b: F.lit(float(beta)) * _difference(a, b)
    equal = lambda a, b: 1 / F.cosh(scaled(a, b) / 2)
    return {
        "soft_eq": Predicate(2, prob=equal),
        "soft_neq": Predicate(2, prob=lambda a, b: 1 - equal(a, b)),
        "soft_gt": Predicate(2, prob=lambda a, b: sigmoid(scaled(a, b))),
        "soft_lt": Predicate(2, prob=lambda a, b: sigmoid(scaled(b, a))),
    }


def _shape(x: Typed) -> Column:
    """(dimension, size) of a tensor; its rows are of one length."""
    sizes, inner = [], x[0]
    for k in range(TENSORS[x[1]]):
        sizes.append(F.struct(F.lit(k).cast("bigint").alias("c0"), F.coalesce(F.size(inner), F.lit(0)).cast("bigint").alias("c1")))
        inner = F.get(inner, 0)
    return F.array(*sizes)


def _difference(a: Typed, b: Typed) -> Column:
    return (a[0] - b[0]).cast("double")


PREDICATES: dict[str, Predicate] = {
    "range": Predicate(2, ("=0",), rows=_range, unique=True),
    "string_chars": Predicate(1, ("usize", "char"), rows=_characters, unique=True),
    "string_index": Predicate(1, ("usize",), rows=_byte_places, unique=True),
    "string_find": Predicate(2, ("usize", "usize"), rows=_found, unique=True),
    "string_split": Predicate(2, ("String",), rows=_parts, unique=True),
    "datetime_ymd": Predicate(1, ("i32", "u32", "u32"), rows=lambda d: F.array(F.struct(F.year(d[0]).alias("c0"), F.month(d[0]).cast("bigint").alias("c1"), F.dayofmonth(d[0]).cast("bigint").alias("c2")))),
    "tensor_shape": Predicate(1, ("usize", "i64"), rows=_shape, unique=True),
    "float_eq": Predicate(2, holds=lambda a, b: F.abs(a[0] - b[0]) < 0.001),
    **soft_comparisons(),
    "new_tag_variable": Predicate(0, prob=lambda: F.lit(1.0)),
}
