"""Catalyst strategy for one structure a source: members of fixed sizes, some of them there only under a condition on earlier ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..decode.box import Runtime, Stage
from ..errors import ExprError
from ..lang.ast import Block, Name, Node
from .columns import Spot, decode_leaf, leaves_of, scalar_of, spots


class _NoPlan(Exception):
    pass


def record(rt: Runtime, stages: list[Stage], data: Column, kind: T.DataType) -> Column | None:
    """The structure at the start of `data` as a Column of type `kind`, or None if it has no such plan.

    As in the decoder a member that isn't live, or that lies outside of the data, is null, and of live members that share a
    name the last counts.
    """
    last = stages[-1]
    if len(stages) != 1 or last.kind != "struct" or last.block.attrs or not isinstance(kind, T.StructType):
        return None
    try:
        found = _members(rt, last.block, data)
    except (_NoPlan, ExprError):
        return None
    if any(f.name not in found for f in kind.fields):
        return None
    return F.struct(*(F.coalesce(*reversed(found[f.name])).cast(f.dataType).alias(f.name) for f in kind.fields))


def _members(rt: Runtime, block: Block, data: Column) -> dict[str, list[Column]]:
    size = F.coalesce(F.length(data), F.lit(0))
    at, fixed = F.lit(0), True  # where the next member begins, and whether that is the same everywhere
    known: dict[str, tuple[Column, str]] = {}
    out: dict[str, list[Column]] = {}
    for f in block.fields:
        c = rt.choices(f.expr)
        width = rt.fixed_size(c[0][0]) if len(c) == 1 else None
        if width is None:
            raise _NoPlan
        live = None
        for test, want in f.conds:
            held = _condition(test, block, known)
            live = (held if want else ~held) if live is None else live & (held if want else ~held)
        if f.name is not None or c[0][-1].kind == "struct":
            if leaves_of(rt, c[0]) is None:
                raise _NoPlan
            tree = spots(rt, c[0])
            for k in [0] if f.name is not None else [i for i, x in enumerate(tree) if x.up == 0]:
                name = f.name if f.name is not None else tree[k].name
                value = _value(rt, tree, k, data, at, size)
                value = value if live is None else F.when(live, value)
                out.setdefault(name, []).append(value)
                if live is None and fixed and tree[k].leaf is not None and name not in known:
                    known[name] = value, "int" if tree[k].kind == "integer" else "string"
        at = at + (F.lit(width) if live is None else F.when(live, F.lit(width)).otherwise(F.lit(0)))
        fixed = fixed and live is None
    return out


def _value(rt: Runtime, tree: list[Spot], k: int, data: Column, at: Column, size: Column) -> Column:
    """The k-th node of a tree of spots; a structure is there if it begins within the data, a leaf if it ends there."""
    spot = tree[k]
    if spot.leaf is not None:
        return F.when(at + (spot.offset + spot.size) <= size, decode_leaf(rt, spot.leaf, data, at))
    inner = [_value(rt, tree, i, data, at, size).alias(x.name) for i, x in enumerate(tree) if x.up == k]
    if not inner:
        raise _NoPlan
    return F.when(at + spot.offset <= size, F.struct(*inner))


def _condition(test: Node, block: Block, known: dict[str, tuple[Column, str]]) -> Column:
    """A condition over members whose places are the same everywhere."""
    for n in _names(test):
        if n.scope is not block or n.name not in known or any(s.name == n.name for s in block.lets):
            raise _NoPlan
    column, kind = scalar_of(test, known)
    if kind != "bool":
        raise _NoPlan
    return column


def _names(test: Node) -> list[Name]:
    from ..decode.box import _walk

    return [n for n in _walk(test) if isinstance(n, Name)]
