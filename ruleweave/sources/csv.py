"""CSV files as relations, and relations as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import ProgramError
from ..types import SPARK

#: The tag of rows that have one, before it becomes a tag.
PROB = "__prob"


def read_csv(
    spark: SparkSession,
    path: str,
    kinds: list[str] | None,
    deliminator: str = ",",
    has_header: bool = False,
    has_probability: bool = False,
    keys: list[str] | str | None = None,
    fields: list[str] | None = None,
) -> DataFrame:
    """Columns c0, c1, ... of the given types, and the probability if the first column has one.

    ``fields`` selects columns of the header. ``keys`` unpivots the others (or ``fields``) to (keys..., field, value).
    """
    if len(deliminator) != 1:
        raise ProgramError("the deliminator is one character")
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    reader = spark.read.option("sep", deliminator).option("mode", "FAILFAST")
    if has_header or keys or fields:
        raw = reader.option("header", True).option("inferSchema", False).csv(path)
    elif kinds is None:
        raw = reader.csv(path)
    else:
        n = len(kinds) + has_probability
        width = len(reader.csv(path).columns)
        if width != n:
            raise ProgramError(f"{path} has {width} columns, not {n}")
        raw = reader.schema(T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(n)])).csv(path)
    for name in (*keys, *(fields or [])):
        if name not in raw.columns:
            raise ProgramError(f"{path} has no column {name}")
    columns = raw.columns
    if keys:
        others = [c for c in (fields or columns) if c not in keys]
        raw = raw.unpivot(keys, others, "field", "value")
        columns = [*keys, "field", "value"]
    elif fields:
        columns = list(fields)
    prob = None
    if has_probability:
        prob, columns = F.col(f"`{columns[0]}`").cast("double").alias(PROB), columns[1:]
    kinds = kinds or ["String"] * len(columns)
    if len(kinds) != len(columns):
        raise ProgramError(f"{path} has {len(columns)} columns, not {len(kinds)}")
    # a value that doesn't fit its type stops the read, as a cast does in ANSI mode
    cast = [F.col(f"`{c}`").cast(SPARK[t]).alias(f"c{k}") for k, (c, t) in enumerate(zip(columns, kinds, strict=True))]
    return raw.select(*cast, *([prob] if prob is not None else []))


def write_csv(df: DataFrame, path: str, deliminator: str = ",") -> None:
    """The rows without header and tag."""
    df.write.mode("overwrite").option("sep", deliminator).csv(path)
