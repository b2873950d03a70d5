"""Spark types of schema types and path expressions, worked out on the driver before any data is read."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from ..decode.box import FUNCTIONS, Box, Data, Runtime, Stage
from ..lang.ast import Array, Binary, Block, Call, Chain, Lit, Member, Name, Node, ScopeRef, SelfRef, Slice, Subscript, Unary

DEEPEST = 12
TEXT = T.StringType()  # what has no single type is given as JSON
NUMBERS = {"integer", "varint", "formatted_integer"}


class Place:
    """A statically known kind of box: its chain of filters and the place it is in."""

    def __init__(self, stages: list[Stage], up: Place | None = None):
        self.stages, self.up = stages, up

    @property
    def last(self) -> Stage:
        return self.stages[-1]


def infer(rt: Runtime, e: Node, at: Place | None = None, depth: int = 0):
    """A Place, a Spark scalar type, or None where the kind depends on data."""
    if depth > 30:
        return None
    go = lambda x, p=at: infer(rt, x, p, depth + 1)
    if isinstance(e, Lit):
        return T.BooleanType() if isinstance(e.value, bool) else T.LongType() if isinstance(e.value, int) else T.BinaryType()
    if isinstance(e, Unary):
        if e.op == "^":
            p = go(e.arg)
            return Place(p.stages[:-1], p.up) if isinstance(p, Place) and len(p.stages) > 1 else p
        return T.BooleanType() if e.op == "!" else T.LongType()
    if isinstance(e, Binary):
        return T.BooleanType() if e.op in ("==", "!=", "<", "<=", ">", ">=", "&&", "||") else T.LongType()
    if isinstance(e, Call):
        return T.LongType() if isinstance(e.func, Name) and e.func.name in FUNCTIONS[:2] else None
    if isinstance(e, SelfRef):
        return at
    if isinstance(e, Data):
        return Place([Stage("source", e)])
    if isinstance(e, (Array, Block)):
        c = rt.choices(e)
        return Place(c[0], at) if len(c) == 1 else None
    if isinstance(e, Chain):
        left, right = go(e.left), rt.choices(e.right)
        return Place(left.stages + right[0], left.up) if isinstance(left, Place) and len(right) == 1 else None
    if isinstance(e, Subscript):
        return item_of(rt, go(e.base))
    if isinstance(e, Slice):
        p = go(e.base)
        return p if not isinstance(p, Place) or p.last.kind == "array" else Place([Stage("bslice", None)], p)
    if isinstance(e, Name):
        for block, kind, stmts in rt.candidates(e.name, e.scope):
            where = at
            while where is not None and not any(s.block is block for s in where.stages):
                where = where.up
            found = [_statement(rt, kind, s, where, e.name, depth) for s in stmts]
            return found[0] if len({str(as_spark(rt, f)) for f in found}) == 1 else None
        c = rt.choices(e)
        return Place(c[0], at) if len(c) == 1 else None
    if isinstance(e, (Member, ScopeRef)):
        p = go(e.base)
        if not isinstance(p, Place) or p.last.block is None:
            return None
        return member_of(rt, p, e.name, depth)
    return None


def _statement(rt, kind, s, where, name, depth):
    if kind == "field":
        c = rt.choices(s.expr)
        return Place(c[0], where) if len(c) == 1 else None
    if kind == "anon":
        c = rt.choices(s.expr)
        return member_of(rt, Place(c[0], where), name, depth + 1) if len(c) == 1 else None
    return infer(rt, s.expr, where, depth + 1)


def member_of(rt: Runtime, p: Place, name: str, depth: int = 0):
    b = p.last.block
    for kind, group in (("let", b.lets), ("field", b.fields), ("attr", b.attrs)):
        mine = [_statement(rt, kind, s, p, name, depth) for s in group if s.name == name]
        if mine:
            return mine[0] if len({str(as_spark(rt, f)) for f in mine}) == 1 else None
    for s in b.fields:
        if s.name is None and rt.anonymous(s, name, b):
            return _statement(rt, "anon", s, p, name, depth)
    return None


def item_of(rt: Runtime, p):
    if not isinstance(p, Place):
        return None
    if p.last.kind != "array" or rt.is_bytes(p.last):
        return Place([rt.bare["byte"]], p)
    c = rt.item_stages(p.last)
    return Place(c[0], p) if len(c) == 1 else None


def as_spark(rt: Runtime, p, depth: int = 0, seen: frozenset = frozenset()) -> T.DataType:
    """The Spark type of an inferred kind. Recursive types and fields of several kinds are JSON text."""
    if p is None or depth > DEEPEST:
        return TEXT
    if isinstance(p, T.DataType):
        return p
    k = p.last.kind
    if k in NUMBERS:
        return T.LongType()
    if k == "user":
        return TEXT
    if k == "array" and not rt.is_bytes(p.last):
        inner = as_spark(rt, item_of(rt, p), depth + 1, seen)
        return TEXT if inner is None else T.ArrayType(inner)
    if k in ("struct", "union"):
        if p.last in seen:
            return TEXT
        return T.StructType(_fields(rt, p, depth, seen | {p.last}))
    return T.BinaryType()


def _fields(rt: Runtime, p: Place, depth: int, seen: frozenset) -> list[T.StructField]:
    out: dict[str, T.DataType] = {}

    def put(name: str, kind: T.DataType) -> None:
        out[name] = kind if name not in out or out[name] == kind else TEXT

    for f in p.last.block.fields:
        c = rt.choices(f.expr)
        if f.name is not None:
            put(f.name, as_spark(rt, Place(c[0], p), depth + 1, seen) if len(c) == 1 else TEXT)
        else:
            for chain in c:
                if chain[-1].kind in ("struct", "union") and chain[-1] not in seen:
                    for g in _fields(rt, Place(chain, p), depth + 1, seen | {chain[-1]}):
                        put(g.name, g.dataType)
    return [T.StructField(k, v) for k, v in out.items()]


def plain(v):
    """A value for JSON: bytes as latin-1 text."""
    if isinstance(v, bytes):
        return v.decode("latin-1")
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


def fit(v, kind: T.DataType):
    """A decoded value in the shape of its Spark type."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return json.dumps(plain(v)) if isinstance(v, (dict, list)) else v.decode("latin-1") if isinstance(v, bytes) else json.dumps(v)
    if isinstance(kind, T.StructType):
        return {f.name: fit(v.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [fit(x, kind.elementType) for x in v]
    return v


def lazy(b: Box, kind: T.DataType):
    """Like fit, on a box: decodes the members of the type only. A member that fails is null; what fails as a whole raises."""
    from ..errors import PathError

    if isinstance(kind, T.StructType) and b.stage.kind in ("struct", "union"):
        out = {}
        for f in kind.fields:
            try:
                v = b.member(f.name)
                out[f.name] = lazy(v, f.dataType) if isinstance(v, Box) else fit(v, f.dataType)
            except PathError:
                out[f.name] = None
        return out
    if isinstance(kind, T.ArrayType) and b.stage.kind in ("array", "slice"):
        return [lazy(x, kind.elementType) for x in b.items()]
    return fit(b.deep(), kind)
