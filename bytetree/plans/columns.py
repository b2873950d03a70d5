"""Catalyst strategy: constant layouts and scalar expressions as built-in Column functions, with no Python on the executors."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..decode.box import Runtime, Stage
from ..errors import ExprError
from ..lang.ast import Binary, Block, Lit, Name, Node, Unary
from ..lang.parser import parse_expression


# ---------------------------------------------------------------- scalar expressions
def _wrapped(exact: Column, wide: Column) -> Column:
    """exact, or where that overflows the same sum in decimals, wrapped to 64 bits."""
    two63, two64 = (F.lit(str(1 << k)).cast("decimal(38,0)") for k in (63, 64))
    return F.coalesce(exact, (F.pmod(wide + two63, two64) - two63).cast("long"))


def _dec(c: Column, digits: int = 20) -> Column:
    return c.cast(f"decimal({digits},0)")


def _arith(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return _wrapped(F.try_add(a, b), _dec(a) + _dec(b))
    if op == "-":
        return _wrapped(F.try_subtract(a, b), _dec(a) - _dec(b))
    if op == "*":
        return _wrapped(F.try_multiply(a, b), (_dec(a, 19) * _dec(b, 19)).cast("decimal(38,0)"))
    safe = F.nullif(b, F.lit(0).cast("long"))
    if op == "/":
        return F.when(b == -1, _wrapped(F.try_subtract(F.lit(0).cast("long"), a), -_dec(a))).otherwise(F.call_function("div", a, safe))
    return F.when(b == -1, F.lit(0).cast("long")).otherwise(a % safe)


_BITS = {"|": lambda a, b: a.bitwiseOR(b), "&": lambda a, b: a.bitwiseAND(b), "^": lambda a, b: a.bitwiseXOR(b)}
_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def scalar(text: str, names: dict[str, tuple[Column, str]]) -> tuple[Column, str]:
    """(Column, kind) of a path expression over named columns; kind is int, bool or string, as in names.

    Strings are compared as bytes. Arithmetic wraps at 64 bits; division by zero gives null. Null operands give null, on
    either side of && and || too.
    """
    return _scalar(parse_expression(text), names)


def scalar_of(e: Node, names: dict[str, tuple[Column, str]]) -> tuple[Column, str]:
    """`scalar` of a tree."""
    return _scalar(e, names)


def _scalar(e: Node, names: dict) -> tuple[Column, str]:
    if isinstance(e, Lit):
        v = e.value
        if isinstance(v, bool):
            return F.lit(v), "bool"
        return (F.lit(v).cast("long"), "int") if isinstance(v, int) else (F.lit(bytearray(v)), "string")
    if isinstance(e, Name):
        if e.name not in names:
            raise ExprError(f"no such name: {e.name}")
        c, kind = names[e.name]
        return (c.cast("long") if kind == "int" else c.cast("binary") if kind == "string" else c), kind
    if isinstance(e, Unary):
        a, k = _scalar(e.arg, names)
        if k != {"!": "bool", "+": "int", "-": "int", "~": "int"}.get(e.op):
            raise ExprError(f"{e.op} of {k}")
        return {"!": lambda: ~a, "+": lambda: a, "-": lambda: _arith("-", F.lit(0).cast("long"), a), "~": lambda: F.bitwise_not(a)}[e.op](), k
    if not isinstance(e, Binary):
        raise ExprError("not a scalar expression")
    (a, k), (b, other) = _scalar(e.left, names), _scalar(e.right, names)
    if k != other:
        raise ExprError(f"{e.op} of different kinds")
    if e.op in ("==", "!="):
        return (a == b if e.op == "==" else a != b), "bool"
    if e.op in ("&&", "||"):
        if k != "bool":
            raise ExprError(f"{e.op} of {k}")
        both = a & b if e.op == "&&" else a | b
        return F.when(a.isNotNull() & b.isNotNull(), both), "bool"
    if k != "int":
        raise ExprError(f"{e.op} of {k}")
    if e.op in _BITS:
        return _BITS[e.op](a, b), "int"
    if e.op in _ORDER:
        return _ORDER[e.op](a, b), "bool"
    if e.op in ("<<", ">>"):
        return F.call_function("shiftleft" if e.op == "<<" else "shiftright", a, b.bitwiseAND(F.lit(63)).cast("int")), "int"
    return _arith(e.op, a, b), "int"


# ---------------------------------------------------------------- constant layouts
@dataclass
class Leaf:
    path: tuple[str, ...]
    offset: int
    width: int
    chain: list[Stage]


@dataclass
class Layout:
    """Records of a fixed width in an array: where it begins, how many there are, and where each member lies in a record."""

    head: int
    tail: int
    width: int
    count: int | None
    leaves: list[Leaf]
    counted: Leaf | None = None  #: the member that holds the number of records, placed from the start
    slices: tuple[tuple[int | None, int | None], ...] = ()  #: bounds of slices of the array, first taken first

    @property
    def sure(self) -> bool:
        """Whether no source can fail."""
        return self.counted is None and not self.slices


def leaves_of(rt: Runtime, chain: list[Stage], at: int = 0, path: tuple[str, ...] = ()) -> list[Leaf] | None:
    """Members of a type of constant layout with their offsets, or None where the layout or a decoder isn't constant."""
    first, last = chain[0], chain[-1]
    width = rt.fixed_size(first)
    if width is None:
        return None
    if last.kind == "struct" and len(chain) == 1:
        if any(f.conds for f in last.block.fields):
            return None
        out, pos = [], at
        for f in last.block.fields:
            c = rt.choices(f.expr)
            w = rt.fixed_size(c[0][0]) if len(c) == 1 else None
            if w is None or f.name is None and c[0][-1].kind == "struct":
                return None
            inner = leaves_of(rt, c[0], pos, (*path, f.name)) if f.name is not None else []
            if inner is None:
                return None
            out += inner
            pos += w
        return out
    if len(chain) == 1 and (last.kind == "byte" or rt.is_bytes(last)):
        return [Leaf(path, at, width, chain)]
    if len(chain) == 2 and (first.kind == "byte" or rt.is_bytes(first)):
        if last.kind == "integer" and width in (1, 2, 4, 8) and all(rt._attr_const(last, a) is not None or not last.attr(a) for a in ("@signed", "@endian")):
            endian = rt._attr_const(last, "@endian")
            return [Leaf(path, at, width, chain)] if width == 1 or endian in (b"big", b"little") else None
        if last.kind == "string" and (not last.attr("@boundary") or rt._attr_const(last, "@boundary")):
            return [Leaf(path, at, width, chain)]
    return None


def decode_leaf(rt: Runtime, leaf: Leaf, data: Column, at: Column) -> Column:
    """The member's value in `data`, whose record starts at byte `at` (from 0)."""
    raw = F.substring(data, at + F.lit(leaf.offset + 1), F.lit(leaf.width))
    last = leaf.chain[-1]
    if last.kind == "integer":
        h = F.hex(raw)
        if leaf.width > 1 and rt._attr_const(last, "@endian") == b"little":
            h = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(leaf.width))))
        n = F.conv(h, 16, -10).cast("long")
        bits = 64 - 8 * leaf.width
        return F.shiftright(F.shiftleft(n, bits), bits) if bits and rt._attr_const(last, "@signed") else n
    if last.kind == "string" and (edge := rt._attr_const(last, "@boundary")):
        p = F.locate(edge.decode("latin-1"), F.decode(raw, "ISO-8859-1"))
        return F.when(p > 0, F.substring(raw, F.lit(1), p - 1)).otherwise(raw)
    return raw


def layout_of(rt: Runtime, stages: list[Stage]) -> Layout | None:
    """Layout of an array of fixed-width records that is the whole type, if it is one."""
    if len(stages) != 1 or stages[0].kind != "array" or rt.is_bytes(stages[0]):
        return None
    items = rt.item_stages(stages[0])
    if len(items) != 1 or rt.last_attr(items[0]):
        return None
    width, length = rt.fixed_size(items[0][0]), rt.array_of(stages[0]).length
    count = rt.const(length)
    if not width or length is not None and count is None:
        return None
    leaves = leaves_of(rt, items[0])
    return Layout(0, 0, width, count, leaves) if leaves else None


def member_layout(rt: Runtime, stages: list[Stage], name: str) -> Layout | None:
    """Layout of the array field `name` of a struct in which all other fields have a fixed size."""
    block = stages[-1].block
    if len(stages) != 1 or stages[0].kind != "struct" or block.attrs or any(f.conds for f in block.fields):
        return None
    spot = [i for i, f in enumerate(block.fields) if f.name == name]
    if len(spot) != 1:
        return None
    c = rt.choices(block.fields[spot[0]].expr)
    if len(c) == 1 and (counter := _counter(rt, block, spot[0], c[0])) is not None:
        return counter
    out = layout_of(rt, c[0]) if len(c) == 1 else None
    sizes = [rt.fixed_size(x[0][0]) if len(x := rt.choices(f.expr)) == 1 else None for f in block.fields]
    rest = [s for i, s in enumerate(sizes) if i != spot[0]]
    if out is None or any(s is None for s in rest):
        return None
    out.head = sum(sizes[: spot[0]])
    out.tail = sum(sizes[spot[0] + 1 :])
    return out


def _counter(rt: Runtime, block: Block, spot: int, stages: list[Stage]) -> Layout | None:
    """Layout of an array whose length is an earlier member of its structure, all members before it being of a fixed size."""
    if len(stages) != 1 or stages[0].kind != "array" or rt.is_bytes(stages[0]):
        return None
    length, items = rt.array_of(stages[0]).length, rt.item_stages(stages[0])
    if not isinstance(length, Name) or len(items) != 1 or rt.last_attr(items[0]):
        return None
    found = next(iter(rt.candidates(length.name, length.scope)), None)
    if found is None or found[0] is not block or found[1] != "field":
        return None
    at, counter = 0, None
    for f in block.fields[:spot]:
        c = rt.choices(f.expr)
        w = rt.fixed_size(c[0][0]) if len(c) == 1 else None
        if w is None:
            return None
        if f.name == length.name:
            own = leaves_of(rt, c[0], at)
            counter = own[0] if own and own[0].path == () and own[0].chain[-1].kind == "integer" else None
        at += w
    width, leaves = rt.fixed_size(items[0][0]), leaves_of(rt, items[0])
    return Layout(at, 0, width, None, leaves, counter) if counter is not None and width and leaves else None


def sliced(layout: Layout, start: Node | None, stop: Node | None) -> Layout | None:
    """The layout of a slice with one constant bound."""
    bounds = [None if e is None else _int(e) for e in (start, stop)]
    if layout.counted is not None or layout.count is not None or (start is None) == (stop is None) or bounds == [None, None]:
        return None
    return replace(layout, slices=(*layout.slices, tuple(bounds)))


def _int(e: Node) -> int | None:
    if isinstance(e, Unary) and e.op == "-" and isinstance(e.arg, Lit):
        return -e.arg.value if isinstance(e.arg.value, int) else None
    return e.value if isinstance(e, Lit) and isinstance(e.value, int) and not isinstance(e.value, bool) else None


@dataclass
class Extent:
    first: Column  #: number of the first record that counts
    n: Column  #: how many count
    status: Column  #: why there are no more, or null
    message: Column


def extent(rt: Runtime, layout: Layout, data: Column) -> Extent:
    """Which records of a source an expression names."""
    size = F.coalesce(F.length(data), F.lit(0))
    none = F.lit(None).cast("string")
    if layout.counted is not None:
        edge = layout.counted.offset + layout.counted.width
        n = F.when(size >= edge, decode_leaf(rt, layout.counted, data, F.lit(0)))
        room = F.floor(F.greatest(size - layout.head, F.lit(0)) / layout.width)
        status = F.when(n.isNull() | (n > room) & (n >= 0), F.lit("out_of_bounds")).when(n < 0, F.lit("data_error"))
        message = F.when(n.isNull(), F.lit("the length is outside of the data")).when(n < 0, F.lit("a negative length")).when(n > room, F.concat(F.lit("item "), room.cast("string"), F.lit(" is outside of its array")))
        return Extent(F.lit(0).cast("long"), F.greatest(F.least(F.coalesce(n, F.lit(0)), room), F.lit(0)).cast("int"), status, message)
    room = F.greatest(size - F.lit(layout.head + layout.tail), F.lit(0))
    n = F.lit(layout.count) if layout.count is not None else F.floor(room / layout.width).cast("int")
    first, status, message = F.lit(0), none, none
    for a, b in layout.slices:
        bound = F.lit(a if a is not None else b)
        at = F.when(bound < 0, bound + n).otherwise(bound)
        bad = (at < 0) | (at > n)
        message = F.coalesce(message, F.when(bad, F.concat(F.lit("the slice bound "), at.cast("string"), F.lit(" is outside of "), n.cast("string"), F.lit(" items"))))
        status = F.coalesce(status, F.when(bad, F.lit("no_item")))
        first, n = (first + at, n - at) if a is not None else (first, at)
    return Extent(first, F.when(status.isNull(), n).otherwise(F.lit(0)), status, message)


def record_type(leaves: list[Leaf]) -> T.DataType:
    return T.LongType() if leaves[0].chain[-1].kind == "integer" else T.BinaryType()


def assemble(rt: Runtime, leaves: list[Leaf], data: Column, at: Column, depth: int = 0) -> Column:
    """One Column with the nesting of the leaves' paths."""
    if len(leaves) == 1 and len(leaves[0].path) == depth:
        return decode_leaf(rt, leaves[0], data, at)
    groups: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        groups.setdefault(leaf.path[depth], []).append(leaf)
    return F.struct(*(assemble(rt, g, data, at, depth + 1).alias(k) for k, g in groups.items()))


# ---------------------------------------------------------------- delimited items
@dataclass
class Delimited:
    """Items that each end at a constant boundary, bare or as the only field of a structure."""

    boundary: bytes
    field: str | None


def delimited(rt: Runtime, stages: list[Stage]) -> Delimited | None:
    """How the items of an array are delimited, if that is all there is to them."""
    d = rt.delimited(stages[0]) if len(stages) == 1 else None
    return Delimited(d[0], d[1].fields[0].name if d[1] is not None else None) if d else None


def split_items(d: Delimited, data: Column) -> Column:
    """The items of `data` as an array of latin-1 text, a character for each byte; no item after a boundary that ends the data."""
    text = F.decode(data, "ISO-8859-1")
    parts = F.split(text, "\\Q" + d.boundary.decode("latin-1").replace("\\E", "\\E\\\\E\\Q") + "\\E")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.length(data) > 0, whole).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- nodes
@dataclass
class Spot:
    """A node of constant place: below a record, or a record itself."""

    depth: int
    ordinal: int
    path: str
    name: str | None
    kind: str
    offset: int
    size: int
    n_items: int | None
    leaf: Leaf | None
    up: int  #: its parent, as a number within the record; -1 for what holds the record


def spots(rt: Runtime, chain: list[Stage], at: int = 0, depth: int = 0, ordinal: int = 0, path: str = "", name: str | None = None, up: int = -1, out: list[Spot] | None = None) -> list[Spot]:
    """The node of a type of constant layout and all nodes below it, in preorder."""
    out = [] if out is None else out
    last, me = chain[-1], len(out)
    width = rt.fixed_size(chain[0])
    if last.kind == "struct" and len(chain) == 1:
        out.append(Spot(depth, ordinal, path, name, "struct", at, width, len(last.block.fields), None, up))
        pos = at
        for i, f in enumerate(last.block.fields):
            c = rt.choices(f.expr)[0]
            if f.name is not None:
                spots(rt, c, pos, depth + 1, i, f"{path}.{f.name}", f.name, me, out)
            pos += rt.fixed_size(c[0])
    else:
        out.append(Spot(depth, ordinal, path, name, last.kind, at, width, None, leaves_of(rt, chain, at)[0], up))
    return out


def node_columns(rt: Runtime, layout: Layout, items: list[Stage], top: tuple[int, str] | None, data: Column, i: Column, n: Column, kinds: T.StructType) -> Column:
    """The nodes above the records where i is -1, else those of the i-th record, as an array of structures of type `kinds`.

    top: the number of members of the structure that holds the array, and the array's name, where there is such a structure.
    """
    own = spots(rt, items)
    above = 1 if top is None else 2
    start = F.lit(above).cast("long") + i.cast("long") * len(own)
    stem = "" if top is None else top[1]
    base = i.cast("long") * layout.width

    def row(**v) -> Column:
        return F.struct(*(v.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields))

    def node(k: int, s: Spot) -> Column:
        v = decode_leaf(rt, s.leaf, data, base) if s.leaf is not None else None
        number = v is not None and s.kind == "integer"
        place = F.concat(F.lit(f"{stem}["), i.cast("string"), F.lit(f"]{s.path}"))
        return row(
            node_id=start + k, parent_id=F.lit(above - 1) if s.up < 0 else start + s.up, depth=F.lit(above + s.depth), ordinal=F.lit(s.ordinal) if k else i, dpath=place,
            name=F.lit(s.name), filter=F.lit(s.kind), space_id=F.lit(0), offset=base + s.offset, size=F.lit(s.size), n_items=F.lit(s.n_items) if v is None else F.lit(None) if number else F.length(v),
            v_int=v if number else F.lit(None), v_bin=F.lit(None) if number or v is None else v,
        )

    zero = F.lit(0)
    heads = []
    if top is not None:
        heads.append(row(node_id=zero, depth=zero, ordinal=zero, dpath=F.lit(""), filter=F.lit("struct"), space_id=zero, offset=zero, size=F.coalesce(F.length(data), zero), n_items=F.lit(top[0])))
    one = F.lit(above - 1)
    heads.append(row(node_id=one, parent_id=F.lit(None) if top is None else zero, depth=one, ordinal=zero, dpath=F.lit(stem), name=F.lit(None if top is None else stem), filter=F.lit("array"), space_id=zero, offset=zero, size=n * layout.width, n_items=n))
    return F.when(i < 0, F.array(*heads)).otherwise(F.array(*(node(k, s) for k, s in enumerate(own))))
