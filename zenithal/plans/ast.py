"""Syntax trees of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object  # str, int, float, Decimal text as float, None


@dataclass(frozen=True)
class ColumnRef:
    name: str
    table: str | None = None
    db: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class In:
    value: object
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Between:
    value: object
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class Like:
    value: object
    pattern: object
    negated: bool


@dataclass(frozen=True)
class IsNull:
    value: object
    negated: bool


@dataclass(frozen=True)
class Not:
    term: object


@dataclass(frozen=True)
class And:
    terms: tuple


@dataclass(frozen=True)
class Or:
    terms: tuple


@dataclass(frozen=True)
class Restrictor:
    """An area restrictor of the WHERE clause; kind is box, circle, ellipse or poly."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class SelectItem:
    expr: object
    alias: str | None
    text: str


@dataclass(frozen=True)
class TableRef:
    name: str
    db: str | None
    alias: str | None


@dataclass(frozen=True)
class Join:
    """How a table joins those before it; kind: comma, cross, inner, natural, left, right (natural flag apart)."""

    table: TableRef
    kind: str
    natural: bool = False
    on: object = None
    using: str | None = None


@dataclass(frozen=True)
class OrderItem:
    expr: object
    descending: bool


@dataclass(frozen=True)
class Select:
    items: tuple
    first: TableRef | None
    joins: tuple
    where: object
    restrictors: tuple
    group_by: tuple
    having: object
    order_by: tuple
    limit: int | None
    distinct: bool


@dataclass(frozen=True)
class Statement:
    """Any statement; kind: select, submit, result, result_delete, cancel, processlist, columns, set_global, ignored."""

    kind: str
    select: Select | None = None
    arg: object = None
    full: bool = False


def walk(node):
    """All nodes of a tree."""
    yield node
    parts = []
    if isinstance(node, (And, Or)):
        parts = node.terms
    elif isinstance(node, Call):
        parts = node.args
    elif isinstance(node, (Binary, Compare)):
        parts = (node.left, node.right)
    elif isinstance(node, In):
        parts = (node.value, *node.items)
    elif isinstance(node, Between):
        parts = (node.value, node.low, node.high)
    elif isinstance(node, Like):
        parts = (node.value, node.pattern)
    elif isinstance(node, IsNull):
        parts = (node.value,)
    elif isinstance(node, Not):
        parts = (node.term,)
    for p in parts:
        yield from walk(p)


def conjuncts(term) -> list:
    """The terms of a top-level AND."""
    if term is None:
        return []
    return [c for t in term.terms for c in conjuncts(t)] if isinstance(term, And) else [term]
