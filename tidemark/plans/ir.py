"""Maintainable plans. Every column is named c<expression id>; relations are bags with weights."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    cols: list[str]


@dataclass
class Scan(Node):
    table: str
    source: list[str]


@dataclass
class Fixed(Node):
    """A source without base table; df as Spark planned it."""

    df: Any


@dataclass
class Filter(Node):
    child: Node
    condition: Any


@dataclass
class Project(Node):
    child: Node
    exprs: list[Any]
    plain: list[str | None]  # the child's column that an expression is, if it is no more than that


@dataclass
class Generate(Node):
    """Rows of child, each with every row that a function of it returns."""

    child: Node
    function: Any
    names: list[str]


@dataclass
class Join(Node):
    left: Node
    right: Node
    kind: str
    condition: Any
    keys: tuple[str, str] | None = None
    equal: list[tuple[str, str]] = field(default_factory=list)  # columns of left and right that have to be equal
    plain: bool = False  # the condition asks for no more than that


@dataclass
class Exists(Node):
    """Rows of child with one more column, the number of matches in inner, where that is not 0."""

    child: Node
    inner: Node
    condition: Any
    count: str
    equal: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Agg:
    kind: str
    arg: Any
    name: str
    type: Any


@dataclass
class View:
    """A definition: body, and what is on top of it."""

    body: Node
    kind: str  # bag, distinct or aggregate
    visible: list[str]
    types: list[Any]
    source: list[str]  # body column of each visible column, None for an aggregate
    aggs: list[Agg] = field(default_factory=list)
    exists: list[str] = field(default_factory=list)
    total: bool = False  # no expression fails, whatever rows it sees

    @property
    def keys(self) -> list[str]:
        return [v for v, s in zip(self.visible, self.source) if s]

    def tables(self) -> list[str]:
        return sorted(set(_tables(self.body)))

    def outer(self) -> bool:
        return any(isinstance(n, Join) and n.kind in ("left", "right", "full") for n in walk(self.body))

    def alone(self) -> bool:
        """One table once, no DISTINCT, no GROUP BY: concurrent insertions do not touch each other's rows."""
        return self.kind == "bag" and not self.exists and len(_tables(self.body)) == 1


def children(n: Node) -> list[Node]:
    return [c for c in (getattr(n, k, None) for k in ("child", "left", "right", "inner")) if c is not None]


def walk(n: Node):
    yield n
    for c in children(n):
        yield from walk(c)


def _tables(n: Node) -> list[str]:
    return [x.table for x in walk(n) if isinstance(x, Scan)]
