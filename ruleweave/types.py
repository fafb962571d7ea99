"""Types of the dialect and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed mapping; unsigned types use the next wider signed one.
SPARK = {
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "isize": T.LongType(),
    "i128": T.DecimalType(38, 0),
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "u128": T.DecimalType(38, 0),
    "usize": T.LongType(),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "bool": T.BooleanType(),
    "char": T.StringType(),
    "String": T.StringType(),
    "Symbol": T.StringType(),
    "DateTime": T.TimestampType(),
    "Duration": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("micros", T.LongType())]),
    "Entity": T.LongType(),
    "Tensor": T.ArrayType(T.DoubleType()),
    "Tensor2": T.ArrayType(T.ArrayType(T.DoubleType())),
    "Tensor3": T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))),
}
#: Tensors by their number of dimensions, nested arrays in Spark.
TENSORS = {"Tensor": 1, "Tensor2": 2, "Tensor3": 3}
_BITS = {"i8": 8, "i16": 16, "i32": 32, "i64": 64, "isize": 64, "i128": 128, "u8": 8, "u16": 16, "u32": 32, "u64": 64, "u128": 128, "usize": 64}
INTEGERS = set(_BITS)
UNSIGNED = {t for t in _BITS if t[0] == "u"}
FLOATS = {"f32", "f64"}
NUMBERS = INTEGERS | FLOATS
TEXTS = {"String", "Symbol", "char"}


def bounds(kind: str) -> tuple[int, int]:
    """Least and greatest value of an integer type; what 38 digits hold for 128 bits, and 63 bits for usize."""
    if kind == "usize":
        return 0, 2**63 - 1
    n = _BITS[kind]
    low, high = (0, 2**n - 1) if kind in UNSIGNED else (-(2 ** (n - 1)), 2 ** (n - 1) - 1)
    return max(low, -(10**38 - 1)), min(high, 10**38 - 1)


def of_spark(kind: T.DataType) -> str:
    """The type of a column that comes from a DataFrame."""
    names = {
        T.ByteType: "i8",
        T.ShortType: "i16",
        T.IntegerType: "i32",
        T.LongType: "i64",
        T.FloatType: "f32",
        T.DoubleType: "f64",
        T.BooleanType: "bool",
        T.StringType: "String",
        T.TimestampType: "DateTime",
        T.TimestampNTZType: "DateTime",
        T.DateType: "DateTime",
    }
    if type(kind) in names:
        return names[type(kind)]
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return "i128"
    depth, inner = 0, kind
    while isinstance(inner, T.ArrayType):
        depth, inner = depth + 1, inner.elementType
    if depth in TENSORS.values():
        return next(t for t, n in TENSORS.items() if n == depth)
    if isinstance(kind, T.StructType) and kind.fieldNames() == ["months", "micros"]:
        return "Duration"
    raise ValueError(f"no type for columns of {kind.simpleString()}")
