"""Syntax trees of schemas and path expressions. Nodes are plain, picklable and never changed after parsing."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    pass


@dataclass(eq=False)
class Lit(Node):
    value: int | bool | bytes


@dataclass(eq=False)
class Name(Node):
    name: str
    scope: Block | None  # the innermost block around the place where the name is written


@dataclass(eq=False)
class SelfRef(Node):
    pass


@dataclass(eq=False)
class Member(Node):
    base: Node
    name: str


@dataclass(eq=False)
class ScopeRef(Node):
    base: Node
    name: str


@dataclass(eq=False)
class Chain(Node):
    left: Node
    right: Node


@dataclass(eq=False)
class Subscript(Node):
    base: Node
    index: Node
    twin: Node | None = None


@dataclass(eq=False)
class Slice(Node):
    base: Node
    start: Node | None
    stop: Node | None
    start_twin: Node | None = None
    stop_twin: Node | None = None


@dataclass(eq=False)
class Unary(Node):
    op: str  # + - ! ~ sizeof & ^
    arg: Node


@dataclass(eq=False)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(eq=False)
class Call(Node):
    func: Node
    args: list[Node]


@dataclass(eq=False)
class Array(Node):
    length: Node | None
    item: Node


@dataclass(eq=False)
class Statement:
    name: str | None
    expr: Node
    conds: tuple[tuple[Node, bool], ...]  # outermost first; each must have the given truth
    index: int = 0


@dataclass(eq=False)
class Block(Node):
    """A filter with a body: `struct {...}`, `string { @boundary: ...; }`, or a whole schema (base None)."""

    base: Node | None
    parent: Block | None
    fields: list[Statement] = field(default_factory=list)
    lets: list[Statement] = field(default_factory=list)
    attrs: list[Statement] = field(default_factory=list)
    externs: list[str] = field(default_factory=list)
    name: str | None = None

    def attr(self, name: str) -> list[Statement]:
        return [s for s in self.attrs if s.name == name]
