"""Expressions evaluated for many sources at once: a `Column` of boxes holds the places of one box in each source as numpy arrays.
No Spark here.

What `Box` does for one source is done here for a run of them, step by step of the expression and of the arrays it walks, and not
source by source. Sources on which anything fails are named in the result and are decoded box by box, so statuses and what can be
read before an error are those of `Box`. An error that `Box` is certain to meet first is given at once, with its message.
Schemas that need more than is written here raise `Unsupported`.
"""

from __future__ import annotations

import sys
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..errors import DataError, NoItemError, OutOfBoundsError, PathError, Unsupported
from ..lang.ast import Array, Binary, Block, Call, Chain, Lit, Member, Name, Node, ScopeRef, SelfRef, Slice, Subscript, Unary
from .box import RAW, Data, Runtime, Stage, TypeVal, binary
from .codecs import wrap

STEPS = 1 << 16  #: items of one array after which a source is left to boxes
GROUPS = 9  #: seven-bit groups of the longest varint decoded here
_BUSY = object()


@dataclass(eq=False)
class Frame:
    """The source of each element of a column; single if no source has two elements."""

    rows: np.ndarray
    single: bool


class Batch:
    """A run of sources: their bytes end to end, and what failed in which of them."""

    def __init__(self, rt: Runtime, slot: Data, sources: pa.Array, exact: bool, probe: bool = False):
        self.rt, self.slot, self.exact, self.probe, self.aside = rt, slot, exact, probe, 0
        raw = sources.fill_null(b"") if sources.null_count else sources
        n = len(raw)
        _, ends, data = raw.buffers() if n else (None, None, None)
        at = np.frombuffer(ends, np.int32, n + 1, 4 * raw.offset).astype(np.int64) if n else np.zeros(1, np.int64)
        low, high = int(at[0]), int(at[-1])
        self.data = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(1, np.uint8)
        self.lo, self.hi = at[:-1] - low, at[1:] - low
        self.failed, self.left = np.zeros(n, bool), np.zeros(n, bool)
        self.known: list[tuple[int, str, str]] = []  #: (source, status, message)
        self.memo: dict = {}
        self.columns: list[Column] = []
        frame = Frame(np.arange(n), True)
        self.source = Column(self, Stage("source", slot), frame, self.lo, self.hi)

    def close(self) -> None:
        """Give up all columns at once: they refer to each other, and their arrays would wait for a collection of cycles."""
        for c in self.columns:
            c.__dict__.clear()
        self.__dict__.clear()

    @contextmanager
    def loose(self):
        """What fails inside may be more than boxes would look at, so it is no answer."""
        self.aside += 1
        try:
            yield
        finally:
            self.aside -= 1

    def fail(self, frame: Frame, where: np.ndarray, error: type[PathError] | None = None, message=None) -> None:
        hit = np.flatnonzero(where)
        hit = hit[~self.failed[frame.rows[hit]]]
        if not len(hit):
            return
        rows = frame.rows[hit]
        if error is not None and self.exact and frame.single and not self.aside:
            self.known += [(int(r), error.status, message(int(i))) for r, i in zip(rows, hit, strict=True)]
        else:
            self.left[rows] = True
        self.failed[rows] = True

    def byte(self, at: np.ndarray) -> np.ndarray:
        return self.data[np.clip(at, 0, len(self.data) - 1)]

    def spots(self, edge: bytes) -> np.ndarray:
        """Where a byte occurs."""
        if edge not in self.memo:
            self.memo[edge] = np.flatnonzero(self.data == edge[0])
        return self.memo[edge]

    def varint_ends(self) -> np.ndarray:
        if "varint" not in self.memo:
            self.memo["varint"] = np.flatnonzero(self.data < 128)
        return self.memo["varint"]

    def next_in(self, spots: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first of the spots from `at` on and before `stop`, or -1."""
        if not len(spots):
            return np.full(len(at), -1, np.int64)
        k = np.searchsorted(spots, at)
        found = spots[np.minimum(k, len(spots) - 1)]
        return np.where((k < len(spots)) & (found < stop), found, -1)

    # ------------------------------------------------------------ evaluation
    def ev(self, e: Node, box: Column | None):
        how = _EV.get(type(e))
        if how is None:
            raise Unsupported(type(e).__name__)
        return how(self, e, box)

    def value(self, e: Node, box: Column | None):
        v = self.ev(e, box)
        if isinstance(v, Column):
            return v.value()
        if isinstance(v, TypeVal):
            raise Unsupported("a type as a value")
        return v

    def chain_of(self, e: Node) -> list[Stage]:
        options = self.rt.choices(e)
        if len(options) != 1 or not options[0]:
            raise Unsupported("a type that depends on data")
        return options[0]

    def ev_lit(self, e: Lit, box):
        return e.value

    def ev_self(self, e, box):
        if box is None:
            raise Unsupported("self outside of data")
        return box

    def ev_type(self, e, box):
        if isinstance(e, Block) and e.base is not None and self.rt.stage(e).kind == "file":
            raise Unsupported("a file")
        return TypeVal(e, box)

    def ev_data(self, e: Data, box):
        if e is not self.slot:
            raise Unsupported("a second source")
        return self.source

    def ev_name(self, e: Name, box: Column | None):
        for block, kind, stmts in self.rt.candidates(e.name, e.scope):
            if len(stmts) != 1 or stmts[0].conds or kind not in ("let", "field"):
                raise Unsupported("a name under conditions")
            owner = box.climb(block) if box is not None else None
            if owner is None and kind == "field":
                continue
            return owner.field(stmts[0]) if kind == "field" else self.ev(stmts[0].expr, owner)
        if e.name in self.rt.bare and e.name not in self.rt.externals:
            return TypeVal(e, box)
        raise Unsupported(e.name)

    def ev_member(self, e: Member, box):
        v = self.ev(e.base, box)
        if isinstance(v, Column):
            return v if e.name == "self" else v.member(e.name)
        if not isinstance(v, TypeVal):
            raise Unsupported("a member of a value")
        block = self.chain_of(v.node)[-1].block
        for s in block.lets if block else ():
            if s.name == e.name and not s.conds:
                return self.ev(s.expr, v.box)
        raise Unsupported("a member of a type")

    def ev_scope(self, e: ScopeRef, box):
        t = self.ev(e.base, box)
        block = self.chain_of(t.node)[-1].block if isinstance(t, TypeVal) else None
        owner = box.climb(block) if box is not None and block is not None else None
        if owner is None:
            raise Unsupported("no enclosing instance")
        return owner if e.name == "self" else owner.member(e.name)

    def ev_chain(self, e: Chain, box):
        left = self.ev(e.left, box)
        if isinstance(left, TypeVal):
            return TypeVal(e, box)
        if not isinstance(left, Column):
            raise Unsupported("a filter over a value")
        return left.chain(self.chain_of(e.right))

    def ev_subscript(self, e: Subscript, box):
        base = self.ev(e.base, box)
        if not isinstance(base, (Column, Cut)):
            raise Unsupported("a subscript of a value")
        k, twin = self.value(e.index, box), self.value(e.twin, box) if e.twin is not None else 0
        return base.find(k, twin) if isinstance(k, bytes) else base.at(_number(k))

    def ev_slice(self, e: Slice, box):
        base = self.ev(e.base, box)
        if not isinstance(base, Column) or e.start_twin is not None or e.stop_twin is not None:
            raise Unsupported("a slice of this kind")
        n = base.length()

        def edge(k, default):
            if k is None:
                return default
            v = np.broadcast_to(np.asarray(_number(self.value(k, box))), n.shape)
            v = np.where(v < 0, v + n, v)
            self.fail(base.frame, (v < 0) | (v > n), NoItemError, lambda i: f"the slice bound {v[i]} is outside of {n[i]} items")
            return v

        a, b = edge(e.start, np.zeros_like(n)), edge(e.stop, n)
        self.fail(base.frame, a > b)
        return Cut(base, a, b)

    def ev_unary(self, e: Unary, box):
        if e.op in ("sizeof", "&", "^"):
            v = self.ev(e.arg, box)
            if isinstance(v, TypeVal) and e.op == "sizeof":
                w = self.rt.fixed_size(self.chain_of(v.node)[0])
                if w is None:
                    raise Unsupported("sizeof a type of no fixed size")
                return w
            if not isinstance(v, Column) or e.op == "^" and v.origin is not None:
                raise Unsupported(f"{e.op} of this")
            if e.op == "^":
                return v.prev or v
            offset, size = v.location()
            return size if e.op == "sizeof" else offset
        v = self.value(e.arg, box)
        if e.op == "!":
            if not _is_bool(v):
                raise Unsupported("! of an integer")
            return ~v if isinstance(v, np.ndarray) else not v
        v = _number(v)
        out = {"+": v, "-": -v, "~": ~v}[e.op]
        return out if isinstance(out, np.ndarray) else wrap(out)

    def ev_binary(self, e: Binary, box):
        a, b, op = self.value(e.left, box), self.value(e.right, box), e.op
        if not isinstance(a, np.ndarray) and not isinstance(b, np.ndarray):
            return binary(op, a, b)
        if isinstance(a, bytes) or isinstance(b, bytes) or _is_bool(a) != _is_bool(b):
            raise Unsupported(f"{op} of these kinds")
        if op in ("==", "!="):
            return a == b if op == "==" else a != b
        if _is_bool(a):
            if op not in ("&&", "||"):
                raise Unsupported(f"{op} of booleans")
            return a & b if op == "&&" else a | b
        if op in "/%":
            x, y = np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(b, np.int64))
            odd = (y == 0) | (y == -1)
            frame = box.frame if box is not None else self.source.frame
            self.fail(frame, odd)
            y = np.where(odd, 1, y)
            q = np.where((x < 0) == (y < 0), np.abs(x) // np.abs(y), -(np.abs(x) // np.abs(y)))
            self.fail(frame, x == np.iinfo(np.int64).min)
            return q if op == "/" else x - q * y
        if op not in _OPS:
            raise Unsupported(op)
        return _OPS[op](a, b)

    def ev_call(self, e: Call, box):
        name = e.func.name if isinstance(e.func, Name) else None
        if name == "len" and len(e.args) == 1:
            v = self.ev(e.args[0], box)
            if not isinstance(v, (Column, Cut)):
                raise Unsupported("len of a value")
            return v.length()
        if name != "index" or len(e.args) != 2:
            raise Unsupported(f"{name}")
        arr, item = (self.ev(a, box) for a in e.args)
        arr = arr.base if isinstance(arr, Cut) else arr
        if not isinstance(arr, Column) or not isinstance(item, Column) or len(arr.frame.rows) != len(item.frame.rows):
            raise Unsupported("index of these")
        base, mine = arr.origin if arr.origin is not None else (arr, None)
        b, idx = item, None
        while b is not None:
            if b.origin is not None:
                b, idx = b.origin[0], _after(b.origin[1], idx)
            if b.container is base and b.index is not None:
                own = _after(b.owner, idx)
                if own is not None or mine is not None:
                    here = np.arange(len(item.frame.rows))
                    self.fail(item.frame, (here if own is None else own) != (here if mine is None else mine))
                return b.index if idx is None else b.index[idx]
            b, idx = (b.prev, idx) if b.prev is not None else (b.container, _after(b.owner, idx))
        raise Unsupported("an item of another array")

    # ------------------------------------------------------------ results
    def touch(self, v, kind: pa.DataType) -> None:
        """Evaluate all of v that `arrow` will give, so that what fails is known."""
        if isinstance(v, Cut):
            v = v.items()
        if not isinstance(v, Column):
            return
        if pa.types.is_struct(kind):
            for f in kind:
                self.touch(v.named(f.name), f.type)
        elif pa.types.is_list(kind):
            self.touch(v.items(), kind.value_type)
        elif pa.types.is_int64(kind):
            v.value()
        elif pa.types.is_binary(kind):
            v.text()
        else:
            raise Unsupported(str(kind))

    def arrow(self, v, kind: pa.DataType) -> pa.Array:
        if not isinstance(v, Column):
            return pa.array(v, kind)
        if pa.types.is_struct(kind):
            return pa.StructArray.from_arrays([self.arrow(v.named(f.name), f.type) for f in kind], fields=list(kind))
        if pa.types.is_list(kind):
            sizes, items = v.parts()
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), self.arrow(items, kind.value_type)).cast(kind)
        if pa.types.is_int64(kind):
            return pa.array(v.value(), kind)
        start, size = v.text()
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.data[at]))])


def _after(first: np.ndarray | None, then: np.ndarray | None) -> np.ndarray | None:
    """The map that takes an element through `then` and on through `first`; None changes nothing."""
    return then if first is None else first if then is None else first[then]


def _is_bool(v) -> bool:
    return v.dtype == bool if isinstance(v, np.ndarray) else isinstance(v, bool)


def _number(v):
    if _is_bool(v) or isinstance(v, bytes):
        raise Unsupported("not an integer")
    return v


_OPS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "|": lambda a, b: a | b, "&": lambda a, b: a & b, "^": lambda a, b: a ^ b,
    "<<": lambda a, b: np.left_shift(a, b & 63), ">>": lambda a, b: np.right_shift(a, b & 63),
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


class Column:
    """One box of each element of a frame. `owner` leads from elements to those of the container's frame, None if they are the same;
    a column taken from another one leads there by `origin`."""

    def __init__(self, batch: Batch, stage: Stage, frame: Frame, start=None, stop=None, prev: Column | None = None, container: Column | None = None, owner=None, index=None, origin=None):
        self.batch, self.stage, self.frame, self.start, self.stop = batch, stage, frame, start, stop
        self.prev, self.container, self.owner, self.index, self.origin = prev, container, owner, index, origin
        self.memo: dict = {}
        batch.columns.append(self)

    def _once(self, key, make):
        v = self.memo.get(key)
        if v is _BUSY:
            raise Unsupported("a layout that depends on itself")
        if v is None:
            self.memo[key] = _BUSY
            try:
                v = self.memo[key] = make()
            except BaseException:
                del self.memo[key]
                raise
        return v

    def _there(self, make) -> np.ndarray:
        """Arrays of the column this one is taken from, at this one's elements."""
        base, idx = self.origin
        with self.batch.loose():
            v = make(base)
        return v[idx] if isinstance(v, np.ndarray) else tuple(x[idx] for x in v)

    def take(self, idx: np.ndarray, frame: Frame) -> Column:
        base, own = self.origin if self.origin is not None else (self, None)
        idx = _after(own, idx)
        return Column(self.batch, self.stage, frame, base.start[idx], base.stop[idx], origin=(base, idx))

    def then(self, st: Stage) -> Column:
        if self.origin is not None:
            base, idx = self.origin
            with self.batch.loose():
                return base.then(st).take(idx, self.frame)

        def make():
            start, size = self.text() if self.stage.kind == "string" else (self.start, self.span())
            return Column(self.batch, st, self.frame, start, start + size, prev=self)

        if st.kind not in ("byte", "bytes", "integer", "varint", "string", "struct", "array"):
            raise Unsupported(st.kind)
        return self._once(("then", st), make)

    def chain(self, stages: list[Stage]) -> Column:
        out = self
        for st in stages:
            out = out.then(st)
        return out

    def climb(self, block: Block) -> Column | None:
        b, idx = self, None
        while b is not None:
            if b.stage.block is block:
                return b if idx is None else b.take(idx, self.frame)
            if b.origin is not None:
                b, idx = b.origin[0], _after(b.origin[1], idx)
            b, idx = (b.prev, idx) if b.prev is not None else (b.container, _after(b.owner, idx))
        return None

    # ------------------------------------------------------------ extent
    def attr(self, name: str) -> Node | None:
        found = self.stage.attr(name)
        if len(found) > 1 or found and found[0].conds:
            raise Unsupported(f"{name} under conditions")
        return found[0].expr if found else None

    def _bound(self) -> np.ndarray | None:
        """@span, the only bound of a size that is known here."""
        if self.attr("@minspan") is not None or self.attr("@maxspan") is not None:
            raise Unsupported("bounds of a size")
        e = self.attr("@span")
        if e is None:
            return None

        def make():
            n = self._full(_number(self.batch.value(e, self)))
            self.batch.fail(self.frame, n < 0, DataError, lambda i: "@span is negative")
            return np.maximum(n, 0)

        return self._once("bound", make)

    def _full(self, v) -> np.ndarray:
        return v if isinstance(v, np.ndarray) else np.full(len(self.frame.rows), v, np.int64)

    def max_end(self) -> np.ndarray:
        if self.stage.kind != "struct" or (n := self._bound()) is None:
            return self.stop
        with self.batch.loose():
            end = self.start + n
            self.batch.fail(self.frame, end > self.stop)
        return np.minimum(end, self.stop)

    def span(self) -> np.ndarray:
        if self.origin is not None:
            return self._once("span", lambda: self._there(lambda b: b.span()))

        def make():
            n = self._span()
            self.batch.fail(self.frame, n < 0, DataError, lambda i: "a negative size")
            self.batch.fail(self.frame, self.start + n > self.stop, OutOfBoundsError, lambda i: f"{n[i]} bytes where {self.stop[i] - self.start[i]} are left")
            return n

        return self._once("span", make)

    def _span(self) -> np.ndarray:
        st, rt = self.stage, self.batch.rt
        fixed = rt.fixed_size(st)
        if fixed is not None:
            return self._full(fixed)
        if st.kind == "array":
            return self._array_span()
        if st.kind == "struct":
            n = self._bound()
            return self._used() if n is None else n
        if self.prev is not None or st.kind in RAW:
            return self.stop - self.start
        if st.kind == "varint":
            end = self.batch.next_in(self.batch.varint_ends(), self.start, self.stop)
            self.batch.fail(self.frame, end < 0, DataError, lambda i: "a varint without its last byte")
            return np.where(end < 0, 0, end + 1 - self.start)
        if st.kind == "string":
            return self._string()[1]
        raise Unsupported(f"no size of {st.kind}")

    def _string(self) -> tuple[np.ndarray, np.ndarray]:
        def make():
            left, e = self.stop - self.start, self.attr("@boundary")
            edge = self.batch.rt.const(e)
            if e is None:
                return left, left
            if not isinstance(edge, bytes) or len(edge) != 1:
                raise Unsupported("a boundary of this kind")
            at = self.batch.next_in(self.batch.spots(edge), self.start, self.stop)
            return np.where(at < 0, left, at - self.start), np.where(at < 0, left, at + 1 - self.start)

        return self._once("string", make)

    def _used(self) -> np.ndarray:
        fields, rt = self._fields(), self.batch.rt
        if rt.fills(self.stage) and any(rt.uses_slack(self.batch.chain_of(f.expr)[0]) for f in fields):
            return self.max_end() - self.start
        if not fields:
            return self._full(0)
        last = self.first(fields[-1])
        return last.start + last.span() - self.start

    # ------------------------------------------------------------ structures
    def _fields(self) -> list:
        block = self.stage.block
        if self.stage.kind != "struct" or any(f.conds for f in block.fields) or self.batch.rt.trail_from(self.stage) < len(block.fields):
            raise Unsupported("a structure of this kind")
        return block.fields

    def first(self, f) -> Column:
        def make():
            fields, rt = self._fields(), self.batch.rt
            st = self.batch.chain_of(f.expr)[0]
            if st.kind not in ("byte", "bytes", "varint", "string", "struct", "array"):
                raise Unsupported(st.kind)
            if f.index:
                b = self.first(fields[f.index - 1])
                start = b.start + b.span()
            else:
                start = self.start
            stop = self.max_end()
            self.batch.fail(self.frame, start > (stop if rt.uses_slack(st) else self.stop), OutOfBoundsError, lambda i: "a field starts outside of its container")
            return Column(self.batch, st, self.frame, start, stop, container=self)

        return self._once(("first", f.index), make)

    def field(self, f) -> Column:
        if self.origin is not None:
            base, idx = self.origin
            with self.batch.loose():
                return base.field(f).take(idx, self.frame)
        return self._once(("field", f.index), lambda: self.first(f).chain(self.batch.chain_of(f.expr)[1:]))

    def member(self, name: str):
        block = self.stage.block
        if block is None or self.stage.kind != "struct":
            raise Unsupported(f"{name} of {self.stage.kind}")
        for kind, found in (("let", block.lets), ("field", block.fields)):
            mine = [s for s in found if s.name == name]
            if len(mine) > 1 or mine and mine[0].conds:
                raise Unsupported("a member under conditions")
            if mine:
                return self.batch.ev(mine[0].expr, self) if kind == "let" else self.field(mine[0])
        raise Unsupported(name)

    def named(self, name: str) -> Column:
        v = self.member(name)
        if not isinstance(v, Column):
            raise Unsupported("a member that is no field")
        return v

    # ------------------------------------------------------------ arrays
    def bytelike(self) -> bool:
        return self.stage.kind in ("byte", "bytes", "source") or self.stage.kind == "array" and self.batch.rt.is_bytes(self.stage)

    def _items(self) -> tuple[list[Stage], int | None]:
        """The items' chain, and their size where it is fixed and nothing in an item ends the array."""
        if self.stage.kind != "array" or self.bytelike():
            raise Unsupported(f"items of {self.stage.kind}")
        rt, c = self.batch.rt, self.batch.rt.item_stages(self.stage)
        if len(c) != 1 or not c[0]:
            raise Unsupported("items of several kinds")
        w = None if rt.last_attr(c[0]) else rt.fixed_size(c[0][0])
        if w == 0 or c[0][0].kind not in ("byte", "varint", "string", "struct", "array"):
            raise Unsupported("items of this kind")
        return c[0], w

    def count(self) -> np.ndarray | None:
        e = self.batch.rt.array_of(self.stage).length
        if e is None:
            return None

        def make():
            n = self._full(_number(self.batch.value(e, self)))
            self.batch.fail(self.frame, n < 0, DataError, lambda i: "a negative length")
            return np.maximum(n, 0)

        return self._once("count", make)

    def _array_span(self) -> np.ndarray:
        if self.bytelike():
            n = self.count()
            return self.stop - self.start if n is None else n
        _, w = self._items()
        if w is not None:
            n = self.count()
            return n * w if n is not None else (self.stop - self.start) // w * w
        counts, first, starts, ends = self.walk()
        out = np.zeros(len(counts), np.int64)
        some = counts > 0
        out[some] = ends[first[some] + counts[some] - 1] - self.start[some]
        return out

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(items of each element, number of its first item, start and end of each item) of an array of items of variable size."""
        return self._once("walk", self._cuts if self.batch.rt.delimited(self.stage) else self._walk)

    def _walk(self):
        batch, rt, (items, _), n = self.batch, self.batch.rt, self._items(), self.count()
        last, least = rt.last_attr(items), max(1, rt.min_size(items[0]))
        live, at, got = np.arange(len(self.frame.rows)), self.start.copy(), np.zeros(len(self.frame.rows), np.int64)
        steps: list[tuple] = []
        with batch.loose() if n is None else nullcontext():
            while True:
                more = got[live] < n[live] if n is not None else self.stop[live] - at[live] >= least
                live = live[more & ~batch.failed[self.frame.rows[live]]]
                if not len(live) and (steps or not batch.probe):
                    break
                frame = Frame(self.frame.rows[live], self.frame.single)
                here, number = at[live], got[live]
                if len(steps) >= STEPS:
                    batch.fail(frame, np.ones(len(live), bool))
                    break
                box = Column(batch, items[0], frame, here, self.stop[live], container=self, owner=live, index=number)
                size = box.span()
                if n is None:
                    batch.fail(frame, size == 0)
                good = ~batch.failed[frame.rows]
                at[live[good]] += size[good]
                got[live[good]] += 1
                steps.append((live[good], here[good], at[live[good]]))
                if last:
                    done = box.chain(items[1:]).last()
                    live = live[~done]
        own, starts, ends = (np.concatenate([s[k] for s in steps]) if steps else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(own, kind="stable")
        return got, np.cumsum(got) - got, starts[order], ends[order]

    def last(self) -> np.ndarray:
        e = self.attr("@last")
        v = self.batch.value(e, self)
        if not _is_bool(v):
            raise Unsupported("@last that isn't boolean")
        return v if isinstance(v, np.ndarray) else np.full(len(self.frame.rows), v)

    def _cuts(self):
        """What `walk` gives, of items that each end at a byte."""
        edge = self.batch.rt.delimited(self.stage)[0]
        if len(edge) != 1:
            raise Unsupported("a boundary of several bytes")
        spots = self.batch.spots(edge)
        a, b = np.searchsorted(spots, self.start), np.searchsorted(spots, self.stop)
        cut = b - a
        ends_there = (cut > 0) & (spots[np.maximum(b - 1, 0)] == self.stop - 1) if len(spots) else np.zeros(len(a), bool)
        counts = cut + ((self.stop > self.start) & ~ends_there)
        first = np.cumsum(counts) - counts
        own = np.repeat(np.arange(len(counts)), counts)
        k = np.arange(len(own)) - first[own]
        at = a[own] + k
        ends = np.where(k < cut[own], spots[np.minimum(at, len(spots) - 1)] + 1, self.stop[own]) if len(spots) else self.stop[own]
        starts = np.where(k == 0, self.start[own], np.r_[0, ends[:-1]]) if len(own) else ends
        return counts, first, starts, ends

    def length(self) -> np.ndarray:
        if self.origin is not None:
            return self._there(lambda b: b.length())
        if self.bytelike():
            return self.span()
        if self.stage.kind == "string":
            return self._string()[0]
        _, w = self._items()
        if not self.batch.rt.last_attr(self._items()[0]):
            n = self.count()
            if n is not None:
                return n
            if w:
                return np.maximum((self.stop - self.start) // w, 0)
        return self.walk()[0]

    def items(self) -> Column:
        """All items of all elements."""
        if self.origin is not None:
            return self.parts()[1]

        def make():
            chain, w = self._items()
            if w is not None:
                n = self.length()
                with self.batch.loose():
                    self.batch.fail(self.frame, n > (self.stop - self.start) // w)
                n = np.where(self.batch.failed[self.frame.rows], 0, n)
                own = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(own)) - (np.cumsum(n) - n)[own]
                starts = self.start[own] + number * w
                self.memo["table"] = n, np.cumsum(n) - n
            else:
                with self.batch.loose():
                    n, first, starts, _ = self.walk()
                own = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(own)) - first[own]
                self.memo["table"] = n, first
            box = Column(self.batch, chain[0], Frame(self.frame.rows[own], False), starts, self.stop[own], container=self, owner=own, index=number)
            return box.chain(chain[1:])

        return self._once("items", make)

    def parts(self) -> tuple[np.ndarray, Column]:
        """(number of items, the items) of each element."""
        base, idx = self.origin if self.origin is not None else (self, np.arange(len(self.frame.rows)))
        with self.batch.loose():
            items = base.items()
        n, first = base.memo["table"]
        n = n[idx]
        own = np.repeat(np.arange(len(n)), n)
        at = first[idx][own] + np.arange(len(own)) - (np.cumsum(n) - n)[own]
        return n, items.take(at, Frame(self.frame.rows[own], False))

    def at(self, k) -> Column:
        """The k-th item of each element."""
        base, idx = self.origin if self.origin is not None else (self, None)
        chain, w = base._items()
        k = self._full(k)
        if (k < 0).any():
            k = np.where(k < 0, k + self.length(), k)
        none = lambda i: f"no item {k[i]}"
        if w is not None:
            n = self.length()
            self.batch.fail(self.frame, (k < 0) | (k >= n), NoItemError, none)
            start = self.start + k * w
            self.batch.fail(self.frame, start + w > self.stop, OutOfBoundsError, lambda i: f"item {k[i]} is outside of its array")
        else:
            with self.batch.loose() if "walk" not in base.memo else nullcontext():
                counts, first, starts, _ = base.walk()
            n, first = (counts, first) if idx is None else (counts[idx], first[idx])
            bad = (k < 0) | (k >= n)
            self.batch.fail(self.frame, bad, NoItemError, none)
            start = starts[np.where(bad, 0, first + k)] if len(starts) else np.zeros(len(k), np.int64)
        box = Column(self.batch, chain[0], self.frame, start, self.stop, container=base, owner=idx, index=k)
        return box.chain(chain[1:])

    def find(self, key: bytes, twin, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Column:
        """The item with the key, the twin-th of those in items low up to high."""
        d = self.batch.rt.delimited(self.stage) if self.stage.kind == "array" else None
        if self.origin is not None or not isinstance(twin, int) or isinstance(twin, bool) or twin < 0 or d is None or own_key(d[1]) is None:
            raise Unsupported("a key of this kind")
        counts, first, starts, ends = self.walk()
        sizes = ends - starts - (self.batch.byte(ends - 1) == d[0][0])
        hit = np.flatnonzero(sizes == len(key))
        for j, c in enumerate(key):
            hit = hit[self.batch.data[starts[hit] + j] == c]
        own = np.searchsorted(first + counts, hit, side="right")
        number = hit - first[own]
        if low is not None:
            inside = (number >= low[own]) & (number < high[own])
            own, number = own[inside], number[inside]
        fresh = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        rank = np.arange(len(own)) - np.repeat(at, np.diff(np.r_[at, len(own)]))
        k = np.full(len(counts), -1, np.int64)
        k[own[rank == twin]] = number[rank == twin]
        text = f"no item with the key {key!r}" + ("{%d}" % twin if twin else "")
        self.batch.fail(self.frame, k < 0, NoItemError, lambda i: text)
        return self.at(np.maximum(k, 0))

    # ------------------------------------------------------------ content
    def location(self) -> tuple[np.ndarray, np.ndarray]:
        """(offset in the source, size)"""
        if self.origin is not None:
            return self._there(lambda b: b.location())
        size = self._string()[0] if self.stage.kind == "string" and self.prev is None else self.span()
        return self.start - self.batch.lo[self.frame.rows], size

    def text(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of a value that is bytes."""
        if self.origin is not None:
            return self._there(lambda b: b.text())
        if self.stage.kind == "string":
            return self.start, self._string()[0]
        if not self.bytelike():
            raise Unsupported(f"bytes of {self.stage.kind}")
        return self.start, self.span()

    def value(self) -> np.ndarray:
        if self.origin is not None:
            return self._there(lambda b: b.value())
        if self.stage.kind not in ("integer", "varint"):
            raise Unsupported(f"the value of {self.stage.kind}")
        return self._once("value", self._varint if self.stage.kind == "varint" else self._integer)

    def _const(self, name: str):
        e = self.attr(name)
        v = self.batch.rt.const(e)
        if e is not None and v is None:
            raise Unsupported(f"{name} that depends on data")
        return v

    def _integer(self) -> np.ndarray:
        w = self.batch.rt.fixed_size(self.prev.stage) if self.prev is not None and self.prev.bytelike() else None
        order, signed = self._const("@endian"), bool(self._const("@signed"))
        order = sys.byteorder.encode() if order == b"native" else order
        if w not in (1, 2, 4, 8) or w > 1 and order not in (b"big", b"little") or order not in (None, b"big", b"little"):
            raise Unsupported("an integer of this kind")
        self.span()
        x = np.zeros(len(self.start), np.uint64)
        for j in range(w) if order == b"big" else range(w - 1, -1, -1):
            x = x << np.uint64(8) | self.batch.byte(self.start + j).astype(np.uint64)
        x = x.view(np.int64)
        return x << (64 - 8 * w) >> (64 - 8 * w) if signed and w < 8 else x

    def _varint(self) -> np.ndarray:
        order = self._const("@endian")
        if order not in (None, b"little", b"big", b"native"):
            raise Unsupported("a varint of this kind")
        stop = self.start + self.span()
        end = self.batch.next_in(self.batch.varint_ends(), self.start, stop)
        self.batch.fail(self.frame, end < 0, DataError, lambda i: "a varint without its last byte")
        size = np.where(end < 0, 0, end + 1 - self.start)
        self.batch.fail(self.frame, size > GROUPS)
        x = np.zeros(len(size), np.int64)
        for j in range(min(int(size.max(initial=0)), GROUPS)):
            g = (self.batch.byte(self.start + j) & np.uint8(127)).astype(np.int64)
            x = np.where(j < size, x | g << 7 * j if order in (None, b"little") else x << 7 | g, x)
        return x


class Cut:
    """A slice: items low up to high of each element of an array."""

    def __init__(self, base: Column, low: np.ndarray, high: np.ndarray):
        if base.origin is not None or base.bytelike() or base._items()[1] is None and not base.batch.rt.delimited(base.stage):
            raise Unsupported("a slice of this kind")
        self.base, self.low, self.high = base, low, high
        if (w := base._items()[1]) is not None:
            with base.batch.loose():
                base.batch.fail(base.frame, (base.length() > (base.stop - base.start) // w))

    def length(self) -> np.ndarray:
        return self.high - self.low

    def at(self, k) -> Column:
        k, n = self.base._full(k), self.length()
        k = np.where(k < 0, k + n, k)
        self.base.batch.fail(self.base.frame, (k < 0) | (k >= n), NoItemError, lambda i: f"no item {k[i]}")
        return self.base.at(np.clip(self.low + k, 0, np.maximum(self.base.length() - 1, 0)))

    def find(self, key: bytes, twin) -> Column:
        return self.base.find(key, twin, self.low, self.high)

    def items(self) -> Column:
        all_, n = self.base.items(), self.base.memo["table"][0]
        own = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(own)) - (np.cumsum(n) - n)[own]
        keep = np.flatnonzero((number >= self.low[own]) & (number < self.high[own]))
        return all_.take(keep, Frame(all_.frame.rows[keep], False))


def own_key(block: Block | None) -> str | None:
    """The only field of a structure that is keyed by it."""
    keys = block.attr("@key") if block is not None else []
    if len(keys) != 1 or keys[0].conds or not isinstance(keys[0].expr, Name):
        return None
    name = block.fields[0].name
    return name if keys[0].expr.name == name and not any(s.name == name for s in block.lets) else None


_EV = {
    Lit: Batch.ev_lit, Name: Batch.ev_name, SelfRef: Batch.ev_self, Member: Batch.ev_member, ScopeRef: Batch.ev_scope, Chain: Batch.ev_chain,
    Subscript: Batch.ev_subscript, Slice: Batch.ev_slice, Unary: Batch.ev_unary, Binary: Batch.ev_binary, Call: Batch.ev_call,
    Array: Batch.ev_type, Block: Batch.ev_type, Data: Batch.ev_data,
}


@dataclass
class Answer:
    """What a run of sources gives: columns for the sources in `rows` (an item each, with its ordinal, if items were asked for),
    errors that are certain, and the sources left to boxes."""

    rows: np.ndarray
    ordinal: np.ndarray | None
    values: pa.Array
    known: list[tuple[int, str, str]]
    left: np.ndarray


def evaluate(rt: Runtime, slot: Data, node: Node, sources: pa.Array, kind: pa.DataType, items: bool, probe: bool = False) -> Answer:
    """The expression, or each item of the array that it is, on all sources."""
    plain = not items and not pa.types.is_struct(kind) and not pa.types.is_list(kind)
    b = Batch(rt, slot, sources, plain, probe)
    try:
        return _answer(b, node, kind, items)
    finally:
        b.close()


def _answer(b: Batch, node: Node, kind: pa.DataType, items: bool) -> Answer:
    v = b.ev(node, None)
    if isinstance(v, TypeVal):
        raise Unsupported("a type")
    if items:
        if not isinstance(v, (Column, Cut)):
            raise Unsupported("items of a value")
        with b.loose():
            v = v.items()
    if isinstance(v, Cut):
        raise Unsupported("a slice as a value")
    frame = v.frame if isinstance(v, Column) else b.source.frame
    b.touch(v, kind)
    keep = np.flatnonzero(~b.failed[frame.rows])
    rows = frame.rows[keep]
    if isinstance(v, Column):
        ordinal = _ordinals(rows) if items else None
        return Answer(rows, ordinal, b.arrow(v.take(keep, Frame(rows, frame.single)), kind), b.known, np.flatnonzero(b.left))
    if pa.types.is_boolean(kind) != _is_bool(v) or not pa.types.is_integer(kind) and not pa.types.is_boolean(kind):
        raise Unsupported("a value of another kind")
    v = v if isinstance(v, np.ndarray) else np.full(len(frame.rows), v)
    return Answer(rows, None, pa.array(v[keep], kind), b.known, np.flatnonzero(b.left))


def _ordinals(rows: np.ndarray) -> np.ndarray:
    """The rank of each element among those of its source; a source's elements are together."""
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(at, np.diff(np.r_[at, len(rows)]))



@dataclass
class Words:
    """All items that end at a byte, of a run of sources: each item's source, ordinal, offset, size with the boundary, how many
    earlier ones of its source are the same, and its bytes. counts and sizes are of whole sources."""

    counts: np.ndarray
    sizes: np.ndarray
    own: np.ndarray
    ordinal: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    twin: np.ndarray
    text: pa.Array


def words(rt: Runtime, slot: Data, stage: Stage, sources: pa.Array) -> Words:
    b = Batch(rt, slot, sources, False)
    try:
        return _words(b, stage)
    finally:
        b.close()


def _words(b: Batch, stage: Stage) -> Words:
    rt = b.rt
    counts, first, starts, ends = b.source.then(stage).walk()
    own = np.repeat(np.arange(len(counts)), counts)
    size = ends - starts - (b.byte(ends - 1) == rt.delimited(stage)[0][0])
    stops = np.cumsum(size)
    at = np.repeat(starts - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)
    text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, stops].astype(np.int32)), pa.py_buffer(b.data[at])])
    kinds = text.dictionary_encode()
    same = own * max(1, len(kinds.dictionary)) + kinds.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(same, kind="stable")
    twin = np.empty(len(own), np.int32)
    twin[order] = _ordinals(same[order])
    return Words(counts, b.hi - b.lo, own, np.arange(len(own)) - first[own], starts - b.lo[own], ends - starts, twin, text)
