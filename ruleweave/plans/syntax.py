"""The syntax tree of programs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Const:
    value: Any
    kind: str  # int, float, bool, char, str, symbol, datetime, duration


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Cast:
    of: Any
    type: str


@dataclass(frozen=True)
class IfElse:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class New:
    functor: str
    args: tuple


@dataclass(frozen=True)
class Term:
    """A constructor pattern, or a constant of an algebraic data type."""

    functor: str
    args: tuple


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple
    types: tuple = ()


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Check:
    expr: Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Implies:
    left: Any
    right: Any


@dataclass(frozen=True)
class Case:
    of: Any
    term: Any


@dataclass(frozen=True)
class Range:
    var: Any
    low: Any
    high: Any
    closed: bool


@dataclass(frozen=True)
class Reduce:
    outs: tuple
    op: str
    params: tuple  # (name or None, value)
    args: tuple
    bindings: tuple
    body: Any
    groups: tuple = ()
    where: Any = None
    hard: bool = False


@dataclass(frozen=True)
class Quantified:
    """exists or forall as a literal."""

    op: str
    bindings: tuple
    body: Any
    groups: tuple = ()
    where: Any = None
    negated: bool = False


@dataclass(frozen=True)
class Attribute:
    name: str
    args: tuple = ()
    named: tuple = ()

    def get(self, name: str, place: int | None = None, default: Any = None) -> Any:
        for k, v in self.named:
            if k == name:
                return v
        return self.args[place] if place is not None and place < len(self.args) else default


@dataclass(frozen=True)
class Rule:
    heads: tuple
    body: Any = None
    tag: Any = None
    disjunctive: bool = False
    attributes: tuple = ()


@dataclass(frozen=True)
class Facts:
    name: str
    rows: tuple  # (tag or None, tuple of expressions)
    exclusive: bool = False
    attributes: tuple = ()


@dataclass(frozen=True)
class RelationType:
    name: str
    columns: tuple  # (name or None, type, bound)
    attributes: tuple = ()


@dataclass(frozen=True)
class TypeAlias:
    name: str
    type: str


@dataclass(frozen=True)
class Enum:
    name: str
    members: tuple  # (name, value or None)


@dataclass(frozen=True)
class Data:
    name: str
    variants: tuple  # (functor, types)


@dataclass(frozen=True)
class FunctionType:
    name: str
    args: tuple
    result: str


@dataclass(frozen=True)
class ConstDecl:
    name: str
    type: str | None
    value: Any


@dataclass(frozen=True)
class Import:
    path: str


@dataclass(frozen=True)
class Query:
    atom: Any  # a name or an Atom
    text: str
    attributes: tuple = ()


@dataclass
class ProgramError(Exception):
    message: str
    at: int | None = field(default=None)

    def __str__(self) -> str:
        return self.message if self.at is None else f"line {self.at}: {self.message}"
