"""Terms of algebraic data types from texts, as ``Node(3, Leaf())``."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import FLOATS, INTEGERS, SPARK, TEXTS
from .scalar import entity_value
from .table import Predicate

_TOKEN = re.compile(r"""\s*(?:([A-Za-z_]\w*)|(-?\d+\.\d*(?:[eE][-+]?\d+)?|-?\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([(),]))""")


def parse_term(text: str, variants: Mapping[str, tuple[str, ...]]) -> tuple[int, list[tuple]] | None:
    """The id of a term, and (constructor, id, arguments...) of it and all terms in it; None if the text is no term."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        tokens.append((m.lastindex, m.group(m.lastindex)))
        at = m.end()
    found: list[tuple] = []
    place = 0

    def take(kind: int, word: str | None = None) -> str:
        nonlocal place
        if place >= len(tokens) or tokens[place][0] != kind or word is not None and tokens[place][1] != word:
            raise ValueError(text)
        place += 1
        return tokens[place - 1][1]

    def value(kind: str) -> Any:
        if kind == "Entity":
            return term()
        if kind == "bool":
            return {"true": True, "false": False}[take(1)]
        if kind in TEXTS:
            return ast.literal_eval(take(3))
        number = take(2)
        return float(number) if kind in FLOATS else int(number) if kind in INTEGERS else None

    def term() -> int:
        functor = take(1)
        args: list = []
        take(4, "(")
        for k, kind in enumerate(variants[functor]):
            if k:
                take(4, ",")
            args.append(value(kind))
        take(4, ")")
        made = entity_value(functor, args)
        found.append((functor, made, *args))
        return made

    try:
        whole = term()
    except (KeyError, ValueError, SyntaxError):
        return None
    return (whole, found) if place == len(tokens) else None


def term_function(variants: Mapping[str, tuple[str, ...]]):
    """``$parse_entity``: the id of the term in a text; texts that are no terms drop the row."""

    def run(text: str | None) -> int | None:
        made = None if text is None else parse_term(text, variants)
        return made[0] if made else None

    made = F.udf(run, "bigint")
    return lambda a: (made(a[0]), "Entity")


def term_predicates(variants: Mapping[str, tuple[str, ...]]) -> dict[str, Predicate]:
    """For each constructor, ``terms#C(text, id, arguments...)``: its terms in the term of a text."""

    def rows_of(functor: str):
        fields = [T.StructField(f"c{k}", SPARK[t]) for k, t in enumerate(("Entity", *variants[functor]))]

        def run(text: str | None) -> list[tuple]:
            made = None if text is None else parse_term(text, variants)
            return [x[1:] for x in dict.fromkeys(made[1]) if x[0] == functor] if made else []

        made = F.udf(run, T.ArrayType(T.StructType(fields)))
        return lambda a: made(a[0])

    return {f"terms#{c}": Predicate(1, ("Entity", *kinds), rows=rows_of(c), once=True) for c, kinds in variants.items()}
