"""Expressions on Columns, with the dialect's exact semantics.

What fails gives NULL (a bad cast, NaN, an index out of range), and the row is dropped where the value is used.
Integer + and - saturate; * wraps; integer / truncates. Float division by zero is infinite. Types are names of the dialect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FLOATS, INTEGERS, NUMBERS, SPARK, TENSORS, TEXTS, UNSIGNED, bounds

Typed = tuple[Column, str]


class TypeProblem(Exception):
    """Operands that don't go together."""


def _wide(column: Column, kind: str) -> Column:
    """A type in which sums of two values don't overflow."""
    return column.cast("decimal(38,0)") if kind in ("i64", "u64", "isize", "usize", "i128", "u128") else column.cast("bigint")


def _clamped(column: Column, kind: str) -> Column:
    low, high = (F.lit(str(x)).cast("decimal(38,0)") if kind in ("i64", "isize", "usize", "u64", "i128", "u128") else F.lit(x) for x in bounds(kind))
    return F.least(F.greatest(column, low), high).cast(SPARK[kind])


def _wrapped(column: Column, kind: str) -> Column:
    low, high = bounds(kind)
    if kind in ("i128", "u128"):
        return column.cast(SPARK[kind])
    size, least = (F.lit(str(x)).cast("decimal(38,0)") for x in (high - low + 1, low))
    return (F.pmod(column.cast("decimal(38,0)") - least, size) + least).cast(SPARK[kind])


def no_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def duration(months: Column, micros: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), micros.cast("bigint").alias("micros"))


def _shifted(when: Column, by: Column, sign: int) -> Column:
    moved = when + F.make_interval(months=by["months"] * sign)
    return F.timestamp_micros(F.unix_micros(moved) + by["micros"] * sign)


def binary(op: str, a: Typed, b: Typed) -> Typed:
    """A binary operator on typed columns."""
    (x, s), (y, t) = a, b
    if op in ("&&", "||", "^"):
        if s != "bool" or t != "bool":
            raise TypeProblem(f"{op} needs bool, not {s} and {t}")
        return {"&&": x & y, "||": x | y, "^": x != y}[op], "bool"
    if op in ("==", "!=", "<", "<=", ">", ">="):
        if s != t and not (s in TEXTS and t in TEXTS):
            raise TypeProblem(f"{op} needs operands of one type, not {s} and {t}")
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool"
    if "DateTime" in (s, t) or "Duration" in (s, t):
        return _times(op, a, b)
    if op == "+" and s in TEXTS and t in TEXTS:
        return F.concat(x, y), "String"
    if s != t or s not in NUMBERS | {"Tensor"}:
        raise TypeProblem(f"{op} needs numbers of one type, not {s} and {t}")
    if s == "Tensor":
        return F.zip_with(x, y, {"+": lambda u, v: u + v, "-": lambda u, v: u - v, "*": lambda u, v: u * v}[op]), s
    if s in FLOATS:
        if op == "/":
            infinite = F.when((x == 0) | F.isnan(x), F.lit(None)).otherwise(F.signum(x) * F.lit(float("inf")))
            return no_nan(F.when(y == 0, infinite).otherwise(x / F.when(y != 0, y)).cast(SPARK[s])), s
        if op == "%":
            return no_nan((x % F.when(y != 0, y)).cast(SPARK[s])), s
        return no_nan({"+": x + y, "-": x - y, "*": x * y}[op].cast(SPARK[s])), s
    if op in ("+", "-"):
        u, v = _wide(x, s), _wide(y, s)
        return _clamped(u + v if op == "+" else u - v, s), s
    if op == "*":
        if s in ("i8", "i16", "i32", "u8", "u16"):
            return _wrapped(x.cast("bigint") * y.cast("bigint"), s), s
        return _wrapped(F.try_multiply(x.cast("decimal(38,0)"), y.cast("decimal(38,0)")), s), s
    divisor = F.when(y != 0, y)
    u, v = (x, divisor) if s in ("i128", "u128", "u64") else (x.cast("bigint"), divisor.cast("bigint"))
    out = F.call_function("div", u, v) if op == "/" and s not in ("i128", "u128", "u64") else (u / v if op == "/" else u % v)
    return out.cast(SPARK[s]), s


def _times(op: str, a: Typed, b: Typed) -> Typed:
    """Operators on dates and durations."""
    (x, s), (y, t) = a, b
    if (s, op, t) == ("DateTime", "-", "DateTime"):
        return duration(F.lit(0), F.unix_micros(x) - F.unix_micros(y)), "Duration"
    if s == "DateTime" and t == "Duration" and op in "+-":
        return _shifted(x, y, 1 if op == "+" else -1), "DateTime"
    if (s, op, t) == ("Duration", "+", "DateTime"):
        return _shifted(y, x, 1), "DateTime"
    if s == t == "Duration" and op in "+-":
        sign = 1 if op == "+" else -1
        return duration(x["months"] + sign * y["months"], x["micros"] + sign * y["micros"]), "Duration"
    if s == "Duration" and t == "i32" and op in "*/":
        if op == "*":
            return duration(x["months"] * y, x["micros"] * y), "Duration"
        by = F.when(y != 0, y).cast("bigint")
        return duration(F.call_function("div", x["months"].cast("bigint"), by), F.call_function("div", x["micros"], by)), "Duration"
    if (s, op, t) == ("i32", "*", "Duration"):
        return _times(op, b, a)
    raise TypeProblem(f"{op} doesn't take {s} and {t}")


def unary(op: str, a: Typed) -> Typed:
    x, s = a
    if op == "!":
        if s != "bool":
            raise TypeProblem(f"! needs bool, not {s}")
        return ~x, s
    if s not in NUMBERS:
        raise TypeProblem(f"{op} needs a number, not {s}")
    if op == "+":
        return x, s
    return (-x if s in FLOATS else _clamped(-_wide(x, s), s)), s


def shown(a: Typed) -> Column:
    """A value as text."""
    x, s = a
    if s in FLOATS:
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))
    if s == "DateTime":
        return F.date_format(x, "yyyy-MM-dd HH:mm:ss 'UTC'")
    return x.cast("string")


def cast(a: Typed, kind: str) -> Typed:
    """``as``: numbers wrap between integers and saturate from floats; texts parse or fail; characters give their digit."""
    x, s = a
    if s == kind:
        return x, kind
    if kind in ("String", "Symbol"):
        return shown(a), kind
    if s == "char" and kind in NUMBERS:
        return F.when(x.rlike("^[0-9]$"), x).try_cast(SPARK[kind]), kind
    if s in TEXTS and kind in NUMBERS:
        valid = r"^[+-]?[0-9]+$" if kind in INTEGERS else r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
        found = F.when(x.rlike(valid), x).try_cast(SPARK[kind])
        if kind in UNSIGNED:
            low, high = bounds(kind)
            found = F.when((found >= F.lit(low)) & (found <= F.lit(str(high)).cast("decimal(38,0)")), found)
        return found, kind
    if s in TEXTS and kind == "bool":
        return F.when(x == "true", F.lit(True)).when(x == "false", F.lit(False)), kind
    if s in TEXTS and kind == "char":
        return F.when(F.length(x) == 1, x), kind
    if s in INTEGERS and kind in INTEGERS:
        return _wrapped(x, kind), kind
    if s in NUMBERS and kind in FLOATS:
        return x.cast(SPARK[kind]), kind
    if s in FLOATS and kind in INTEGERS:
        low, high = (float(b) for b in bounds(kind))
        cut = F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)))
        return _clamped(cut.cast("decimal(38,0)"), kind), kind
    if s == "bool" and kind in INTEGERS:
        return x.cast("int").cast(SPARK[kind]), kind
    raise TypeProblem(f"no cast from {s} to {kind}")


def entity(functor: str, args: Sequence[Column]) -> Column:
    """The id of a constructed term: 60 bits of an MD5 over the functor and the arguments."""
    text = F.concat_ws("\u0001", F.lit(functor), *[a.cast("string") for a in args])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def entity_value(functor: str, args: Sequence[object]) -> int:
    """The same for Python values."""
    texts = [functor, *[str(a).lower() if isinstance(a, bool) else str(a) for a in args]]
    return int(hashlib.md5("\u0001".join(texts).encode()).hexdigest()[:15], 16)


# the functions of $name(...)


def _float(function: Callable[[Column], Column]) -> Callable[..., Typed]:
    def run(a: Typed) -> Typed:
        if a[1] not in FLOATS:
            raise TypeProblem(f"a float is needed, not {a[1]}")
        return no_nan(function(a[0]).cast(SPARK[a[1]])), a[1]

    return run


def _rounded(function: Callable[[Column], Column]) -> Callable[..., Typed]:
    return lambda a: (function(a[0]).cast(SPARK[a[1]]) if a[1] in FLOATS else a[0], a[1])


def _text(function: Callable[..., Column], kind: str = "String") -> Callable[..., Typed]:
    return lambda *a: (function(*[x for x, _ in a]), kind)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bytes_between(s: Column, begin: Column, end: Column) -> Column:
    raw = F.encode(s, "utf-8")
    inside = (begin >= 0) & (begin <= end) & (end <= F.octet_length(s))
    return F.when(inside, F.decode(F.substring(raw, (begin + 1).cast("int"), (end - begin).cast("int")), "utf-8"))


def _byte_index(s: Column, part: Column) -> Column:
    at = F.locate_col(part, s) if hasattr(F, "locate_col") else F.call_function("locate", part, s)
    return F.when(at > 0, F.octet_length(F.left(s, at - 1))).cast("bigint")


def _format(pattern: Typed, *args: Typed) -> Typed:
    """``{}`` stands for the next argument. The pattern must be a constant, which the compiler passes as text."""
    pieces = pattern[0].split("{}") if isinstance(pattern[0], str) else None
    if pieces is None or len(pieces) != len(args) + 1:
        raise TypeProblem("$format needs a constant pattern with as many {} as arguments")
    out = [F.lit(pieces[0])]
    for a, piece in zip(args, pieces[1:], strict=True):
        out += [shown(a), F.lit(piece)]
    return F.concat(*out), "String"


def _sign(a: Typed) -> Typed:
    if a[1] in UNSIGNED:
        return F.lit(1).cast(SPARK[a[1]]), a[1]
    if a[1] in FLOATS:
        return F.signum(a[0]).cast("int"), "i32"
    return F.signum(a[0]).cast(SPARK[a[1]]), a[1]


def _extreme(function: Callable[..., Column]) -> Callable[..., Typed]:
    def run(*a: Typed) -> Typed:
        if len({t for _, t in a}) > 1:
            raise TypeProblem("operands of one type are needed")
        return (function(*[x for x, _ in a]) if len(a) > 1 else a[0][0]), a[0][1]

    return run


def _pow(a: Typed, b: Typed) -> Typed:
    exact = F.pow(a[0].cast("double"), b[0].cast("double"))
    low, high = bounds(a[1])
    return F.when((exact >= float(low)) & (exact <= float(high)), exact.cast("decimal(38,0)").cast(SPARK[a[1]])), a[1]


FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "abs": lambda a: (F.abs(a[0]), a[1]),
    "floor": _rounded(F.floor),
    "ceil": _rounded(F.ceil),
    "exp": _float(F.exp),
    "exp2": _float(lambda x: F.pow(F.lit(2.0), x)),
    "log": _float(lambda x: F.ln(F.when(x > 0, x))),
    "log2": _float(lambda x: F.log2(F.when(x > 0, x))),
    "pow": _pow,
    "powf": lambda a, b: (no_nan(F.pow(a[0], b[0]).cast(SPARK[a[1]])), a[1]),
    "sin": _float(F.sin),
    "cos": _float(F.cos),
    "tan": _float(F.tan),
    "asin": _float(F.asin),
    "acos": _float(F.acos),
    "atan": _float(F.atan),
    "atan2": lambda a, b: (no_nan(F.atan2(a[0], b[0]).cast(SPARK[a[1]])), a[1]),
    "sign": _sign,
    "max": _extreme(F.greatest),
    "min": _extreme(F.least),
    "string_concat": _text(F.concat),
    "string_length": lambda a: (F.octet_length(a[0]).cast("bigint"), "usize"),
    "string_char_at": lambda s, i: (F.when((i[0] >= 0) & (i[0] < F.length(s[0])), F.substring(s[0], (i[0] + 1).cast("int"), F.lit(1))), "char"),
    "substring": lambda s, b, e=None: (_bytes_between(s[0], b[0], F.octet_length(s[0]) if e is None else e[0]), "String"),
    "string_index_of": lambda s, p: (_byte_index(s[0], p[0]), "usize"),
    "string_upper": _text(lambda s: F.translate(s, _LOWER, _UPPER)),
    "string_lower": _text(lambda s: F.translate(s, _UPPER, _LOWER)),
    "string_replace": _text(lambda s, a, b: F.replace(s, a, b)),
    "string_trim": _text(lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")),
    "format": _format,
    "hash": lambda *a: (F.xxhash64(*[x for x, _ in a]).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)"), "u64"),
    "datetime_day": lambda a: (F.dayofmonth(a[0]).cast("bigint"), "u32"),
    "datetime_month": lambda a: (F.month(a[0]).cast("bigint"), "u32"),
    "datetime_month0": lambda a: ((F.month(a[0]) - 1).cast("bigint"), "u32"),
    "datetime_year": lambda a: (F.year(a[0]), "i32"),
    "dim": lambda a: (F.when(a[0].isNotNull(), TENSORS[a[1]]).cast("bigint"), "usize"),
    "dot": lambda a, b: (F.aggregate(F.zip_with(a[0], b[0], lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, x: s + x), "f64"),
}
