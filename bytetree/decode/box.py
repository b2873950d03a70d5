"""Lazy evaluation of schemas and path expressions over bytes. Importable without Spark.

A `Box` is one filter applied at one place of a byte source. Its start, extent, output and value are worked out when asked for
and remembered, so an expression decodes what it needs and nothing else. A box that another filter made its input of is that
box's `prev`; the box an item lies in is its `container`. Names are resolved by the block they are written in and evaluated in
the nearest enclosing box of the block that declares them.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import DataError, ExprError, NoDataError, NoItemError, NotContainerError, OutOfBoundsError, SpecError, Unsupported
from ..lang.ast import Array, Binary, Block, Call, Chain, Lit, Member, Name, Node, ScopeRef, SelfRef, Slice, Statement, Subscript, Unary
from ..lang.parser import parse_expression, parse_schema
from . import codecs
from .codecs import wrap

FILTERS = ("byte", "bytes", "integer", "varint", "string", "formatted_integer", "base64", "deflate", "snappy", "file", "struct", "union", "array")
FUNCTIONS = ("len", "index", "env")
RAW = {"bytes", "integer", "formatted_integer", "base64", "deflate", "snappy", "user", "file", "source"}  # claim all there is
DECODERS = {"base64", "deflate", "snappy", "user"}  # their output is a space of its own
DEEPEST = 4096


class Circular(DataError):
    pass


class Source:
    def __init__(self, data: bytes, name: str = ""):
        self.data, self.name = data, name


@dataclass(eq=False)
class Data(Node):
    """A data source as a syntax node, so that boards can bind names to it."""

    source: Source


@dataclass(eq=False)
class External(Node):
    name: str
    func: object
    is_filter: bool


@dataclass(eq=False)
class TypeVal:
    node: Node
    box: Box | None


class Stage:
    """One filter of a chain, with what is known about it whatever the data."""

    __slots__ = ("kind", "node", "block", "base", "memo")

    def __init__(self, kind: str, node: Node | None, base: Stage | None = None):
        self.kind, self.node, self.base, self.memo = kind, node, base, {}
        self.block = node if isinstance(node, Block) else None

    def attr(self, name: str) -> list[Statement]:
        own = self.block.attr(name) if self.block else []
        return own or (self.base.attr(name) if self.base else [])


class Runtime:
    """Names, registered externals and the evaluator. Pickles with its texts, so executors can hold one."""

    def __init__(self) -> None:
        self.board = Block(None, None)
        self.stages: dict[Node, Stage] = {}
        self.files: dict[str, bytes] = {}
        self.bare = {k: Stage(k, None) for k in FILTERS}
        self.flat: dict[Node, list[Stage]] = {}
        self.externals: dict[str, External] = {}
        self.found: dict[tuple, list] = {}
        self.open: set[Statement] = set()

    # ------------------------------------------------------------ board
    def bind(self, name: str, node: Node) -> None:
        self.board.lets = [s for s in self.board.lets if s.name != name] + [Statement(name, node, ())]
        self.flat.clear(), self.found.clear()

    def unbind(self, name: str) -> None:
        if not any(s.name == name for s in self.board.lets) and name not in self.externals:
            raise NoItemError(f"no such name: {name}")
        self.board.lets = [s for s in self.board.lets if s.name != name]
        self.externals.pop(name, None)
        self.flat.clear(), self.found.clear()

    def schema(self, text: str) -> Block:
        try:
            spec = parse_schema(text, self.board)
            self.validate(spec)
        except ExprError as e:
            raise SpecError(str(e)) from e
        return spec

    def evaluate(self, text: str | Node, box: Box | None = None):
        node = parse_expression(text, box.inner_block() if box is not None else self.board) if isinstance(text, str) else text
        if isinstance(text, str):
            self.check_names(node)
        return self.ev(node, box)

    # ------------------------------------------------------------ static resolution
    def candidates(self, name: str, scope: Block | None):
        """(block, kind, statements) where name is declared, innermost first, up to the first unconditional one."""
        known = self.found.get((name, scope))
        if known is None:
            known = list(self._candidates(name, scope))
            if not self.open:
                self.found[name, scope] = known
        return known

    def _candidates(self, name: str, scope: Block | None):
        while scope is not None:
            for kind, found in (("let", scope.lets), ("field", scope.fields), ("attr", scope.attrs)):
                mine = [s for s in found if s.name == name]
                if mine:
                    yield scope, kind, mine
                    if any(not s.conds for s in mine):
                        return
            for s in scope.fields:
                if s.name is None and name[0] != "@" and self.anonymous(s, name, scope):
                    yield scope, "anon", [s]
                    if not s.conds:
                        return
            scope = scope.parent

    def anonymous(self, s: Statement, name: str, scope: Block, depth: int = 0) -> bool:
        """Whether the anonymous field s offers name."""
        if depth > 8 or s in self.open:
            return False  # the type of s is being looked up itself
        self.open.add(s)
        try:
            options = self.choices(s.expr)
        finally:
            self.open.discard(s)
        for stages in options:
            b = stages[-1].block if stages else None
            if b is None or stages[-1].kind not in ("struct", "union"):
                continue
            if any(x.name == name for x in (*b.lets, *b.fields)) or any(x.name is None and self.anonymous(x, name, b, depth + 1) for x in b.fields):
                return True
        return False

    def choices(self, expr: Node, seen: frozenset = frozenset()) -> list[list[Stage]]:
        """Every chain of filters the type expression may stand for."""
        if isinstance(expr, Chain):
            rights = self.choices(expr.right, seen)
            return [a + b for a in self.choices(expr.left, seen) for b in rights]
        if isinstance(expr, Name):
            if (expr.name, expr.scope) in seen:
                return []
            seen = seen | {(expr.name, expr.scope)}
            out = []
            for _, kind, stmts in self.candidates(expr.name, expr.scope):
                if kind != "let":
                    continue
                for s in stmts:
                    out += self.choices(s.expr, seen)
                    if not s.conds:
                        break
            if out:
                return out
            if expr.name in self.bare:
                return [[self.bare[expr.name]]]
            if expr.name in self.externals and self.externals[expr.name].is_filter:
                return [[self.stage(self.externals[expr.name])]]
            return []
        if isinstance(expr, (Array, Block)):
            st = self.stage(expr)
            return [[*st.memo.get("before", []), st]]
        if isinstance(expr, Member):
            base = self.choices(expr.base, seen) if isinstance(expr.base, (Name, Member)) else []
            for stages in base:
                b = stages[-1].block
                for s in b.lets if b else []:
                    if s.name == expr.name:
                        return self.choices(s.expr, seen)
        if isinstance(expr, External):
            return [[self.stage(expr)]]
        return []

    def stage(self, node: Node) -> Stage:
        st = self.stages.get(node)
        if st is None:
            if isinstance(node, Array):
                st = Stage("array", node)
            elif isinstance(node, External):
                st = Stage("user", node)
            elif node.base is None:
                st = Stage("spec", node)
            elif node.base.name in FILTERS and not any(k == "let" for _, k, _ in self.candidates(node.base.name, node.base.scope)):
                st = Stage(node.base.name, node)
                if node.base.name == "array":
                    items, lengths = node.attr("@item"), node.attr("@length")
                    if not items:
                        raise ExprError("an array without @item")
                    st.memo["array"] = Array(lengths[0].expr if lengths else None, items[0].expr)
            else:
                base = self.choices(node.base)
                if not base:
                    raise ExprError(f"no such filter: {node.base.name}")
                st = Stage(base[0][-1].kind, node, base[0][-1])
                st.memo["before"] = base[0][:-1]
            self.stages[node] = st
        return st

    def flatten(self, expr: Node, box: Box | None) -> list[Stage]:
        """The chain of filters a type expression stands for in the given box."""
        known = self.flat.get(expr)
        if known is not None:
            return known
        if isinstance(expr, (Array, Block, External)) or isinstance(expr, Name) and len(options := self.choices(expr)) == 1 and self.fixed_choice(expr):
            out = self.flat[expr] = self.choices(expr)[0]
            return out
        if isinstance(expr, Chain):
            return self.flatten(expr.left, box) + self.flatten(expr.right, box)
        t = self.ev(expr, box)
        if not isinstance(t, TypeVal):
            raise ExprError("expected a type")
        if t.node is expr:
            options = self.choices(expr)
            if not options:
                raise ExprError(f"not a type: {getattr(expr, 'name', expr)}")
            return options[0]
        return self.flatten(t.node, t.box)

    def fixed_choice(self, expr: Name) -> bool:
        """Whether the name stands for the same type everywhere, through aliases."""
        for _, kind, stmts in self.candidates(expr.name, expr.scope):
            return kind == "let" and not stmts[0].conds and self.steady(stmts[0].expr)
        return True

    def steady(self, e: Node) -> bool:
        if isinstance(e, Chain):
            return self.steady(e.left) and self.steady(e.right)
        return self.fixed_choice(e) if isinstance(e, Name) else isinstance(e, (Array, Block, External))

    # ------------------------------------------------------------ static sizes
    def const(self, expr: Node | None):
        """The value of an expression that no data can change, else None."""
        if expr is None or isinstance(expr, Lit):
            return expr.value if expr else None
        try:
            v = self.ev(expr, None)
        except (NoDataError, NoItemError, ExprError, DataError, NotContainerError, Unsupported):
            return None
        return v if isinstance(v, (int, bool, bytes)) else None

    def _attr_const(self, st: Stage, name: str):
        found = st.attr(name)
        return self.const(found[0].expr) if found and not found[0].conds else None

    def array_of(self, st: Stage) -> Array:
        return st.memo.get("array") or st.node

    def item_stages(self, st: Stage) -> list[list[Stage]]:
        if "items" not in st.memo:
            st.memo["items"] = self.choices(self.array_of(st).item)
        return st.memo["items"]

    def is_bytes(self, st: Stage) -> bool:
        if "bytes" not in st.memo:
            st.memo["bytes"] = st.kind == "array" and [[s.kind for s in c] for c in self.item_stages(st)] == [["byte"]]
        return st.memo["bytes"]

    def fixed_size(self, st: Stage) -> int | None:
        """Bytes the filter claims whatever the data, or None."""
        if "fixed" not in st.memo:
            st.memo["fixed"] = None  # while in progress
            st.memo["fixed"] = self._fixed(st)
        return st.memo["fixed"]

    def _fixed(self, st: Stage) -> int | None:
        if st.kind == "byte":
            return 1
        if st.kind == "array":
            n, items = self.const(self.array_of(st).length), self.item_stages(st)
            w = self.fixed_size(items[0][0]) if len(items) == 1 and items[0] else None
            return None if n is None or w is None or any(self.last_attr(c) for c in items) else n * w
        if st.kind in ("struct", "union"):
            span = self._attr_const(st, "@span")
            if span is not None and len(st.attr("@span")) == 1:
                return span
            low, high = self._attr_const(st, "@minspan"), self._attr_const(st, "@maxspan")
            if low is not None and low == high:
                return low
            if st.attr("@span") or st.attr("@minspan") or st.attr("@maxspan"):
                return None
            sizes = []
            for f in st.block.fields:
                options = self.choices(f.expr)
                w = self.fixed_size(options[0][0]) if len(options) == 1 and options[0] and not f.conds else None
                if w is None:
                    return None
                sizes.append(w)
            return (max if st.kind == "union" else sum)(sizes or [0])
        return None

    def min_size(self, st: Stage) -> int:
        if "min" not in st.memo:
            st.memo["min"] = 0
            st.memo["min"] = self._min(st)
        return st.memo["min"]

    def _min(self, st: Stage) -> int:
        if (w := self.fixed_size(st)) is not None:
            return w
        if st.kind == "varint":
            return 1
        if st.kind == "array":
            n, items = self.const(self.array_of(st).length), self.item_stages(st)
            return n * min((self.min_size(c[0]) for c in items if c), default=0) if n and n > 0 else 0
        if st.kind in ("struct", "union"):
            sizes = [min((self.min_size(c[0]) for c in self.choices(f.expr) if c), default=0) for f in st.block.fields if not f.conds]
            hard = (max if st.kind == "union" else sum)(sizes or [0])
            return max(hard, self._attr_const(st, "@minspan") or 0, self._attr_const(st, "@span") or 0)
        return 0

    def last_attr(self, stages: list[Stage]) -> bool:
        return bool(stages and stages[-1].attr("@last"))

    def uses_slack(self, st: Stage) -> bool:
        """Whether the filter, as an item, may claim whatever space is left."""
        if "slack" not in st.memo:
            st.memo["slack"] = False
            if st.kind == "array":
                items = self.item_stages(st)
                free = self.array_of(st).length is None
                st.memo["slack"] = (free and not any(self.last_attr(c) for c in items)) or any(c and self.uses_slack(c[0]) for c in items)
            elif st.kind in ("struct", "union"):
                st.memo["slack"] = not st.attr("@span") and not st.attr("@maxspan") and any(c and self.uses_slack(c[0]) for f in st.block.fields for c in self.choices(f.expr))
            elif st.kind == "string":
                st.memo["slack"] = not st.attr("@boundary")
            else:
                st.memo["slack"] = st.kind in RAW and st.kind not in ("file", "source")
        return st.memo["slack"]

    def fills(self, st: Stage) -> bool:
        """Whether a filter that uses slack claims all of it, not just whole items."""
        if "fills" not in st.memo:
            st.memo["fills"] = False
            if st.kind == "array":
                st.memo["fills"] = self.array_of(st).length is None and self.is_bytes(st)
            elif st.kind in ("struct", "union"):
                st.memo["fills"] = not any(st.attr(a) for a in ("@span", "@minspan", "@maxspan")) and any(c and self.uses_slack(c[0]) for f in st.block.fields for c in self.choices(f.expr))
            else:
                st.memo["fills"] = self.uses_slack(st)
        return st.memo["fills"]

    def delimited(self, st: Stage) -> tuple[bytes, Block | None] | None:
        """(boundary, structure) of an array without a length whose items are strings that end at a constant boundary, bare or
        as the only field of a structure without sizes of its own."""
        if "delimited" not in st.memo:
            st.memo["delimited"] = self._delimited(st)
        return st.memo["delimited"]

    def _delimited(self, st: Stage) -> tuple[bytes, Block | None] | None:
        if st.kind != "array" or self.array_of(st).length is not None or self.is_bytes(st):
            return None
        items, block = self.item_stages(st), None
        if len(items) != 1 or len(items[0]) != 1 or self.last_attr(items[0]):
            return None
        one = items[0][0]
        if one.kind == "struct":
            block = one.block
            if len(block.fields) != 1 or block.fields[0].name is None or block.fields[0].conds or any(a.name != "@key" for a in block.attrs):
                return None
            c = self.choices(block.fields[0].expr)
            if len(c) != 1 or len(c[0]) != 1:
                return None
            one = c[0][0]
        edge = self._attr_const(one, "@boundary") if one.kind == "string" and len(one.attr("@boundary")) == 1 else None
        return (edge, block) if edge else None

    def trail_from(self, st: Stage) -> int:
        """Index of the first field that is placed from the end: what follows the last field that may take slack."""
        if "trail" not in st.memo:
            spread = [i for i, f in enumerate(st.block.fields) if any(c and self.uses_slack(c[0]) for c in self.choices(f.expr))]
            st.memo["trail"] = spread[-1] + 1 if spread and st.kind == "struct" else len(st.block.fields)
        return st.memo["trail"]

    # ------------------------------------------------------------ checks at load time
    def check_names(self, node: Node) -> None:
        for n in _walk(node):
            if isinstance(n, Name) and not self.known(n):
                raise ExprError(f"no such name: {n.name}")

    def known(self, n: Name) -> bool:
        if n.name in self.bare or n.name in FUNCTIONS or n.name in self.externals:
            return True
        b = n.scope
        while b is not None:
            if n.name in b.externs:
                return True
            b = b.parent
        return bool(self.candidates(n.name, n.scope))

    def validate(self, spec: Block) -> None:
        blocks = [spec]
        for n in _walk(spec):
            if isinstance(n, Name) and not self.known(n):
                raise ExprError(f"no such name: {n.name}")
            if isinstance(n, Block) and n is not spec:
                blocks.append(n)
                st = self.stage(n)
                for need, kinds in (("@signed", ("integer",)), ("@output_size", ("deflate",)), ("@path", ("file",))):
                    if st.kind in kinds and not st.attr(need):
                        raise ExprError(f"{st.kind} without {need}")
                if st.kind in ("struct", "union"):
                    for a in n.attrs:
                        if a.name not in ("@span", "@minspan", "@maxspan", "@key", "@last"):
                            raise ExprError(f"no such attribute of {st.kind}: {a.name}")
        for b in blocks:
            for s in b.fields if b is not spec else ():
                if not self.choices(s.expr) and not self._maybe_type(s.expr):
                    raise ExprError(f"the field {s.name or ''} has no type")
            for s in b.lets:
                self._circular(s.expr, [])
        for b in blocks:
            if b is not spec and self.stage(b).kind in ("struct", "union"):
                high, st = self._attr_const(self.stage(b), "@maxspan"), self.stage(b)
                if high is not None and high < self.min_size(st):
                    raise ExprError("@maxspan is below the least size")

    def _maybe_type(self, e: Node) -> bool:
        return isinstance(e, (Member, Chain, ScopeRef)) or isinstance(e, Name) and any(True for _ in self.candidates(e.name, e.scope))

    def _circular(self, e: Node, path: list[Node]) -> None:
        """Reject types of a size that depends on itself, and names that only stand for each other."""
        if any(e is p for p in path):
            raise ExprError("circular dependency")
        path = [*path, e]
        if isinstance(e, Name):
            for _, kind, stmts in self.candidates(e.name, e.scope):
                if kind == "let" and not stmts[0].conds:
                    self._circular(stmts[0].expr, path)
                return
        elif isinstance(e, Chain):
            self._circular(e.left, path)
        elif isinstance(e, Array) and e.length is not None:
            if self.const(e.length) or not isinstance(e.length, Lit):
                if isinstance(e.length, Lit):
                    self._circular(e.item, path)
        elif isinstance(e, Block) and e.base is not None and self.stage(e).kind in ("struct", "union"):
            for f in e.fields:
                if not f.conds:
                    self._circular(f.expr, path)
        elif isinstance(e, Unary) and e.op == "sizeof":
            self._circular(e.arg, path)
        elif isinstance(e, Binary):
            self._circular(e.left, path)
            self._circular(e.right, path)

    # ------------------------------------------------------------ evaluation
    def ev(self, e: Node, box: Box | None):
        return _EV[type(e)](self, e, box)

    def value(self, e: Node, box: Box | None):
        return self.read(self.ev(e, box))

    def read(self, v):
        if isinstance(v, Box):
            out = v.value()
            if out is None:
                raise ExprError("the operand has no value type")
            return out
        if isinstance(v, TypeVal):
            raise NoDataError("the operand is a type")
        return v

    def holds(self, s: Statement, box: Box | None) -> bool:
        for test, want in s.conds:
            v = self.value(test, box)
            if not isinstance(v, bool):
                raise ExprError("a condition that isn't boolean")
            if v is not want:
                return False
        return True

    def ev_lit(self, e: Lit, box):
        return e.value

    def ev_self(self, e, box):
        if box is None:
            raise NoDataError("self outside of data")
        return box

    def ev_type(self, e, box):
        if isinstance(e, Block) and e.base is not None and self.stage(e).kind == "file":
            return Box(self, self.stage(e), container=box)  # a file is data by itself
        return TypeVal(e, box)

    def ev_data(self, e: Data, box):
        return Box(self, Stage("source", e), e.source, 0, len(e.source.data))

    def ev_name(self, e: Name, box: Box | None):
        for block, kind, stmts in self.candidates(e.name, e.scope):
            owner = box.climb(block) if box is not None else None
            v = self.declared(block, kind, stmts, owner, e.name)
            if v is not None:
                return v
        if e.name in self.externals:
            x = self.externals[e.name]
            return TypeVal(x, box) if x.is_filter else _checked(x.func())
        if e.name in self.bare:
            return TypeVal(e, box)
        if any(e.name == s.name for b in _scopes(e.scope) for s in (*b.fields, *b.lets, *b.attrs)):
            raise NoDataError(f"{e.name} outside of data") if box is None else NoItemError(f"{e.name} isn't there")
        raise ExprError(f"no such name: {e.name}")

    def declared(self, block: Block, kind: str, stmts: list[Statement], owner: Box | None, name: str):
        for s in stmts:
            if owner is None and (kind != "let" or s.conds):
                continue
            if not self.holds(s, owner):
                continue
            if kind == "field":
                return owner.field(s)
            if kind == "anon":
                inner = owner.field(s)
                try:
                    return inner.member(name)
                except NoItemError:
                    continue
            return self.ev(s.expr, owner)
        return None

    def ev_member(self, e: Member, box):
        v = self.ev(e.base, box)
        if isinstance(v, Box):
            return v if e.name == "self" else v.member(e.name)
        if isinstance(v, TypeVal):
            stages = self.flatten(v.node, v.box)
            block = stages[-1].block
            for s in block.lets if block else ():
                if s.name == e.name and not s.conds:
                    return self.ev(s.expr, v.box)
            for s in block.fields if block else ():
                if s.name == e.name:
                    return TypeVal(s.expr, v.box)
            raise NoItemError(f"no such name: {e.name}")
        raise NotContainerError(f"{e.name} of a plain value")

    def ev_scope(self, e: ScopeRef, box):
        t = self.ev(e.base, box)
        if not isinstance(t, TypeVal):
            raise ExprError("the left of :: isn't a type")
        block = self.flatten(t.node, t.box)[-1].block
        owner = box.climb(block) if box is not None and block is not None else None
        if owner is None:
            raise NoDataError("no enclosing instance of the type before ::")
        return owner if e.name == "self" else owner.member(e.name)

    def ev_chain(self, e: Chain, box):
        left = self.ev(e.left, box)
        if isinstance(left, TypeVal):
            stages = self.flatten(left.node, left.box)
            if stages[0].kind != "file":
                return TypeVal(e, box)
            out = Box(self, stages[0], None, None, None, container=box)
            for st in (*stages[1:], *self.flatten(e.right, box)):
                out = Box(self, st, prev=out)
            return out
        if not isinstance(left, Box):
            if not isinstance(left, bytes):
                raise ExprError("a filter over a plain value")
            left = Box(self, Stage("source", None), Source(left), 0, len(left), container=box)
        for st in self.flatten(e.right, box):
            left = Box(self, st, prev=left)
        return left

    def ev_subscript(self, e: Subscript, box):
        base = self.ev(e.base, box)
        if not isinstance(base, Box):
            raise NotContainerError("a subscript of a plain value")
        k, twin = self.value(e.index, box), self.value(e.twin, box) if e.twin is not None else 0
        return base.at(k, twin)

    def ev_slice(self, e: Slice, box):
        base = self.ev(e.base, box)
        if not isinstance(base, Box):
            raise NotContainerError("a slice of a plain value")
        n = base.length() if base.sequence() else None
        if n is None:
            raise NotContainerError("a slice of what isn't a sequence")

        def edge(k, twin, default):
            if k is None:
                return default
            v = self.value(k, box)
            if isinstance(v, bytes):
                return base.find(v, self.value(twin, box) if twin is not None else 0)
            v = v + n if v < 0 else v
            if not 0 <= v <= n:
                raise NoItemError(f"the slice bound {v} is outside of {n} items")
            return v

        a, b = edge(e.start, e.start_twin, 0), edge(e.stop, e.stop_twin, n)
        if a > b:
            raise ExprError("a slice that ends before it starts")
        return base.slice(a, b)

    def ev_unary(self, e: Unary, box):
        if e.op == "sizeof":
            v = self.ev(e.arg, box)
            if isinstance(v, Box):
                return v.location()[1]
            if isinstance(v, TypeVal):
                w = self.fixed_size(self.flatten(v.node, v.box)[0])
                if w is None:
                    raise ExprError("sizeof a type of no fixed size")
                return w
            raise ExprError("sizeof a plain value")
        if e.op in "&^":
            v = self.ev(e.arg, box)
            if isinstance(v, TypeVal):
                raise NoDataError("the operand is a type")
            if not isinstance(v, Box):
                raise ExprError(f"{e.op} of a plain value")
            return v.location()[0] if e.op == "&" else v.prev or v
        v = self.value(e.arg, box)
        if e.op == "!":
            if not isinstance(v, bool):
                raise ExprError("! takes a boolean")
            return not v
        if isinstance(v, bool) or not isinstance(v, int):
            raise ExprError(f"{e.op} takes an integer")
        return wrap({"+": v, "-": -v, "~": ~v}[e.op])

    def ev_binary(self, e: Binary, box):
        return binary(e.op, self.value(e.left, box), self.value(e.right, box))

    def ev_call(self, e: Call, box):
        name = e.func.name if isinstance(e.func, Name) else None
        if name == "len" and len(e.args) == 1:
            v = self.ev(e.args[0], box)
            if not isinstance(v, Box):
                raise ExprError("len of a plain value")
            return v.length()
        if name == "index" and len(e.args) == 2:
            arr, item = (self.ev(a, box) for a in e.args)
            if not isinstance(arr, Box) or not isinstance(item, Box):
                raise ExprError("index takes an array and an item")
            while item is not None:
                if item.container is not None and item.container.same(arr) and item.index is not None:
                    return item.index
                item = item.prev or item.container
            raise NoItemError("the item isn't in the array")
        if name == "env" and len(e.args) == 1:
            key = self.value(e.args[0], box)
            if not isinstance(key, bytes) or len(key) > 255:
                raise ExprError("env takes a name of at most 255 bytes")
            for s in self.board.lets:
                if s.name == key.decode("latin-1"):
                    return self.ev(s.expr, None)
            raise NoItemError(f"no such name: {key!r}")
        raise ExprError(f"no such function of {len(e.args)} arguments: {name}")


def _scopes(b: Block | None):
    while b is not None:
        yield b
        b = b.parent


def _checked(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return wrap(v)
    if isinstance(v, str):
        return v.encode("latin-1")
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    raise ExprError(f"an external gave {type(v).__name__}")


_INT = {
    "+": lambda a, b: wrap(a + b), "-": lambda a, b: wrap(a - b), "*": lambda a, b: wrap(a * b),
    "|": lambda a, b: a | b, "&": lambda a, b: a & b, "^": lambda a, b: a ^ b,
    "<<": lambda a, b: wrap(a << (b & 63)), ">>": lambda a, b: a >> (b & 63),
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def binary(op: str, a, b):
    """The operator on two values of one kind; both sides have been evaluated, also for && and ||."""
    if type(a) is not type(b):
        raise ExprError(f"{op} of different kinds")
    if op in ("==", "!="):
        return (a == b) is (op == "==")
    if isinstance(a, bool):
        if op not in ("&&", "||"):
            raise ExprError(f"{op} of booleans")
        return (a and b) if op == "&&" else (a or b)
    if isinstance(a, bytes) or op in ("&&", "||"):
        raise ExprError(f"{op} of {'strings' if isinstance(a, bytes) else 'integers'}")
    if op in "/%":
        if not b:
            raise DataError("division by zero")
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return wrap(q) if op == "/" else wrap(a - q * b)
    return _INT[op](a, b)


def _walk(n):
    if isinstance(n, Node):
        yield n
        for k, v in vars(n).items():
            if k not in ("scope", "parent", "source", "func"):
                yield from _walk(v)
    elif isinstance(n, (list, tuple)):
        for x in n:
            yield from _walk(x)
    elif isinstance(n, Statement):
        yield from _walk(n.expr)
        yield from _walk(n.conds)




_EV = {
    Lit: Runtime.ev_lit, Name: Runtime.ev_name, SelfRef: Runtime.ev_self, Member: Runtime.ev_member, ScopeRef: Runtime.ev_scope, Chain: Runtime.ev_chain,
    Subscript: Runtime.ev_subscript, Slice: Runtime.ev_slice, Unary: Runtime.ev_unary, Binary: Runtime.ev_binary, Call: Runtime.ev_call,
    Array: Runtime.ev_type, Block: Runtime.ev_type, External: Runtime.ev_type, Data: Runtime.ev_data,
}


class Box:
    __slots__ = ("rt", "stage", "_src", "_start", "_stop", "prev", "container", "index", "right", "memo", "depth")

    def __init__(self, rt: Runtime, stage: Stage, src=None, start=None, stop=None, prev: Box | None = None, container: Box | None = None, index: int | None = None, right: bool = False):
        self.rt, self.stage, self._src, self._start, self._stop, self.prev, self.right = rt, stage, src, start, stop, prev, right
        self.container = prev.container if prev is not None else container
        self.index = prev.index if prev is not None else index
        self.memo: dict = {}
        up = prev if prev is not None else container
        self.depth = up.depth + 1 if up is not None else 0
        if self.depth > DEEPEST:
            raise DataError("boxes nest too deeply")

    # ------------------------------------------------------------ place
    def _once(self, key: str, make):
        """make(), remembered; asking again meanwhile is a circular layout."""
        m = self.memo
        if key in m:
            v = m[key]
            if v is _BUSY:
                raise Circular("a layout that depends on itself")
            if isinstance(v, _Failed):
                raise v.error
            return v
        m[key] = _BUSY
        try:
            v = m[key] = make()
        except Exception as e:
            if isinstance(e, Circular):
                m.pop(key, None)
            else:
                m[key] = _Failed(e)
            raise
        return v

    def _input(self):
        return self.prev.output()

    @property
    def src(self) -> Source:
        return self._input()[0] if self.prev is not None else self._src if self.stage.kind != "file" else self._file()

    @property
    def stop(self) -> int:
        if self.prev is not None:
            return self._input()[2]
        if self.stage.kind == "file":
            return len(self._file().data)
        if self._stop is None:
            try:
                self._stop = self.container.max_end()
            except Circular:
                return self.container.stop  # the container's size is being read from this very field
        return self._stop

    @property
    def start(self) -> int:
        if self.prev is not None:
            return self._input()[1]
        if self.stage.kind == "file":
            return 0
        if self._start is None:
            self._start = self.stop - self.span()
            low = self.container.start if self.container is not None and self.container._start is not None else 0
            if self._start < low:
                raise OutOfBoundsError("a trailer larger than its container")
        return self._start

    def _file(self) -> Source:
        def load():
            path = self.attr("@path")
            name = path.decode("utf-8", "surrogateescape")
            if len(path) > 1023:
                raise DataError("the file path is too long")
            if name not in self.rt.files:
                raise NoItemError(f"no such file: {name}")
            return Source(self.rt.files[name], name)

        return self._once("file", load)

    def attr(self, name: str, default=None):
        found = self.stage.memo.get(("attr", name))
        if found is None:
            found = self.stage.memo["attr", name] = self.stage.attr(name)
        for s in found:
            if self.rt.holds(s, self):
                return self.rt.value(s.expr, self)
        return default

    def _bound(self, name: str) -> int | None:
        v = self.attr(name)
        if v is not None and (isinstance(v, bool) or not isinstance(v, int)):
            raise ExprError(f"{name} isn't an integer")
        if v is not None and v < 0:
            raise DataError(f"{name} is negative")
        return v

    def max_end(self) -> int:
        """Where the content must end."""
        if self.stage.kind not in ("struct", "union") or self.memo.get("max") is _BUSY:
            return self.stop

        def make():
            span = self._bound("@span")
            if span is not None:
                end = self.stop if self.right else self.start + span
            else:
                high = self._bound("@maxspan")
                end = self.stop if high is None else min(self.stop, self.start + high)
            if end > self.stop:
                raise OutOfBoundsError(f"a span of {end - self.start} bytes where {self.stop - self.start} are left")
            return end

        return self._once("max", make)

    def span(self) -> int:
        def make():
            n = self._span()
            if n < 0:
                raise DataError("a negative size")
            self.memo["span"] = n  # known already while the bounds below are looked up
            if self._start is not None or self.prev is not None:
                if self.start + n > self.stop:
                    raise OutOfBoundsError(f"{n} bytes where {self.stop - self.start} are left")
            return n

        return self._once("span", make)

    def _span(self) -> int:
        st, rt = self.stage, self.rt
        kind = st.kind
        fixed = rt.fixed_size(st)
        if fixed is not None:
            return fixed
        if kind in ("slice", "bslice"):
            return self._stop - self._start
        if kind == "array":
            return self._array_span()
        if kind in ("struct", "union"):
            span = self._bound("@span")
            if span is not None:
                return span
            used = self._used()
            low = self._bound("@minspan")
            return used if low is None else max(used, low)
        if self.prev is not None or kind in RAW:
            return self.stop - self.start
        if kind == "varint":
            return codecs.varint_size(self.src.data, self.start, self.stop)
        if kind == "string":
            return self._string()[1]
        raise ExprError(f"no size of {kind}")

    def _string(self) -> tuple[int, int]:
        """(length of the value, bytes claimed)"""

        def make():
            memo = self.stage.memo
            if "edge" not in memo:
                memo["edge"] = self.rt._attr_const(self.stage, "@boundary") if len(self.stage.attr("@boundary")) == 1 else None
            edge = memo["edge"] or self.attr("@boundary")
            left = self.stop - self.start
            if not edge:
                return left, left
            at = self.src.data.find(edge, self.start, self.stop)
            return (left, left) if at < 0 else (at - self.start, at - self.start + len(edge))

        return self._once("string", make)

    def _used(self) -> int:
        live = self.fields()
        if self.stage.kind == "union":
            return max((self.first(f).span() for f in live), default=0)
        if self.rt.fills(self.stage) and any(self.rt.uses_slack(self.rt.flatten(f.expr, self)[0]) for f in live):
            return self.max_end() - self.start
        if not live:
            return 0
        trail = self.rt.trail_from(self.stage)
        if live[-1].index >= trail:
            if any(f.index < trail and self.rt.uses_slack(self.rt.flatten(f.expr, self)[0]) for f in live):
                return self.max_end() - self.start
            return sum(self.first(f).span() for f in live)
        last = self.first(live[-1])
        return last.start + last.span() - self.start

    # ------------------------------------------------------------ structures
    def fields(self) -> list[Statement]:
        """Live field statements in order."""
        memo = self.stage.memo
        if "plain" not in memo:
            memo["plain"] = not any(f.conds for f in self.stage.block.fields)
        if memo["plain"]:
            return self.stage.block.fields
        return self._once("live", lambda: [f for f in self.stage.block.fields if self.rt.holds(f, self)])

    def first(self, f: Statement) -> Box:
        """The box of the first filter of a field."""
        return self._once(("first", f.index), lambda: self._first(f))

    def _first(self, f: Statement) -> Box:
        rt, st = self.rt, self.stage
        stage = rt.flatten(f.expr, self)[0]
        if st.kind == "union":
            return Box(rt, stage, self.src, self.start, self.max_end(), container=self)
        trail = rt.trail_from(st)
        if f.index >= trail:
            after = next((g for g in st.block.fields[f.index + 1 :] if rt.holds(g, self)), None)
            end = self.first(after).start if after is not None else self.max_end()
            return Box(rt, stage, self.src, None, end, container=self, right=True)
        before = next((g for g in reversed(st.block.fields[: f.index]) if rt.holds(g, self)), None)
        if before is None:
            start = self.start
        else:
            b = self.first(before)
            start = b.start + b.span()
        stop = None
        if rt.uses_slack(stage):
            stop = self.max_end()
            trailer = next((g for g in st.block.fields[trail:] if rt.holds(g, self)), None)
            if trailer is not None:
                stop = self.first(trailer).start
        if start > (self.stop if stop is None else stop):
            raise OutOfBoundsError("a field starts outside of its container")
        return Box(rt, stage, self.src, start, stop, container=self)

    def field(self, f: Statement) -> Box:
        return self._once(("field", f.index), lambda: self._chain(self.first(f), self.rt.flatten(f.expr, self)))

    def _chain(self, box: Box, stages: list[Stage]) -> Box:
        for st in stages[1:]:
            box = Box(self.rt, st, prev=box)
        return box

    def member(self, name: str):
        block = self.stage.block
        if block is None or self.stage.kind not in ("struct", "union", "array", "spec"):
            raise NotContainerError(f"{name} of {self.stage.kind}")
        rt = self.rt
        for kind, found in (("let", block.lets), ("field", block.fields), ("attr", block.attrs)):
            mine = [s for s in found if s.name == name]
            if mine and (v := rt.declared(block, kind, mine, self, name)) is not None:
                return v
        if name[0] != "@" and self.stage.kind in ("struct", "union"):
            for s in block.fields:
                if s.name is None and rt.anonymous(s, name, block) and rt.holds(s, self):
                    try:
                        return self.field(s).member(name)
                    except NoItemError:
                        continue
        raise NoItemError(f"no such name: {name}")

    def climb(self, block: Block) -> Box | None:
        b: Box | None = self
        while b is not None:
            if b.stage.block is block:
                return b
            b = b.prev if b.prev is not None else b.container
        return None

    def inner_block(self) -> Block:
        b: Box | None = self
        while b is not None:
            if b.stage.block is not None:
                return b.stage.block
            b = b.prev if b.prev is not None else b.container
        return self.rt.board

    # ------------------------------------------------------------ sequences
    def sequence(self) -> bool:
        return self.stage.kind in ("array", "slice") or self.bytelike()

    def bytelike(self) -> bool:
        k = self.stage.kind
        return k in ("byte", "bytes", "base64", "deflate", "snappy", "file", "source", "bslice", "string") or k == "array" and self.rt.is_bytes(self.stage) or k == "user" and isinstance(self.value(), bytes)

    def _item_stages(self) -> list[Stage]:
        return self._once("items", lambda: self.rt.flatten(self.rt.array_of(self.stage).item, self))

    def _count(self) -> int | None:
        def make():
            e = self.rt.array_of(self.stage).length
            if e is None:
                return None
            n = self.rt.value(e, self)
            if isinstance(n, bool) or not isinstance(n, int):
                raise ExprError("a length that isn't an integer")
            if n < 0:
                raise DataError("a negative length")
            return n

        return self._once("count", make)

    def _array_span(self) -> int:
        rt, items = self.rt, self._item_stages()
        w, n = rt.fixed_size(items[0]), self._count()
        if not rt.last_attr(items) and w is not None:
            if n is not None:
                return n * w
            left = self.stop - self.start
            if w == 0:
                raise DataError("an array without a length, of items without a size")
            return left if rt.is_bytes(self.stage) else left // w * w
        self._walk()
        offs = self.memo["offs"]
        return offs[-1] - offs[0]

    def _walk(self, upto: int | None = None) -> bool:
        """Find where items start, through item `upto` or all; whether it is there."""
        m, rt = self.memo, self.rt
        if "offs" not in m:
            m["offs"], m["done"] = [self.start], False
            if (d := rt.delimited(self.stage)) is not None:
                m["offs"], m["done"] = self._cuts(d[0]), True
        offs, items = m["offs"], self._item_stages()
        n, last, stop = self._count(), rt.last_attr(items), self.stop
        least = max(1, rt.min_size(items[0]))
        while not m["done"] and (upto is None or len(offs) <= upto + 1):
            at = offs[-1]
            if (n is not None and len(offs) - 1 >= n) or (n is None and stop - at < least):
                m["done"] = True
                break
            box = Box(rt, items[0], self.src, at, stop, container=self, index=len(offs) - 1)
            try:
                size = box.span()
            except OutOfBoundsError:
                if n is not None:
                    raise
                m["done"] = True
                break
            if n is None and size == 0:
                raise DataError("an item without a size in an array without a length")
            offs.append(at + size)
            m["fresh"] = (len(offs) - 2, box)  # whoever asks for this item next need not start anew
            if last and self._chain(box, items).attr("@last"):
                m["done"] = True
        return upto is None or len(offs) > upto + 1

    def _pieces(self, edge: bytes) -> list[bytes]:
        """The items of a delimited array; none after a boundary that ends the data."""
        parts = self.src.data[self.start : self.stop].split(edge)
        if not parts[-1]:
            parts.pop()
        return parts

    def _cuts(self, edge: bytes) -> list[int]:
        at, k = self.start, len(edge)
        offs = [at, *((at := at + len(p) + k) for p in self._pieces(edge))]
        offs[-1] = min(offs[-1], self.stop)
        return offs

    def length(self) -> int:
        k = self.stage.kind
        if k == "slice":
            return self.memo["hi"] - self.memo["lo"]
        if self.bytelike():
            return len(self.value()) if k in ("string", "user") else (lambda o: o[2] - o[1])(self.output())
        if k in ("struct", "union"):
            return len(self.fields())
        if k != "array":
            raise ExprError(f"len of {k}")
        items = self._item_stages()
        if not self.rt.last_attr(items):
            n, w = self._count(), self.rt.fixed_size(items[0])
            if n is not None:
                return n
            if w:
                return (self.stop - self.start) // w
        self._walk()
        return len(self.memo["offs"]) - 1

    def item(self, i: int) -> Box:
        """The i-th item, counted from the start."""
        if self.stage.kind == "slice":
            if not 0 <= i < self.length():
                raise NoItemError(f"no item {i}")
            b = self.memo["base"].item(self.memo["lo"] + i)
            return b
        if self.bytelike():
            src, a, b = self.output()
            if not 0 <= i < b - a:
                raise NoItemError(f"no item {i}")
            return Box(self.rt, self.rt.bare["byte"], src, a + i, a + i + 1, container=self, index=i)
        if self.stage.kind != "array":
            raise NotContainerError(f"an item of {self.stage.kind}")
        items, rt = self._item_stages(), self.rt
        w = rt.fixed_size(items[0])
        if i < 0:
            raise NoItemError(f"no item {i}")
        if w is not None and not rt.last_attr(items):
            if i >= self.length():
                raise NoItemError(f"no item {i}")
            start = self.start + i * w
            if start + w > self.stop:
                raise OutOfBoundsError(f"item {i} is outside of its array")
        else:
            n = self._count()
            if (n is not None and i >= n) or not self._walk(i):
                raise NoItemError(f"no item {i}")
            k, box = self.memo.get("fresh", _NONE)
            if k == i:
                return self._chain(box, items)
            start = self.memo["offs"][i]
        return self._chain(Box(rt, items[0], self.src, start, self.stop, container=self, index=i), items)

    def items(self):
        """All items in order."""
        if self.stage.kind == "slice" or self.bytelike() or (self.rt.fixed_size(self._item_stages()[0]) is not None and not self.rt.last_attr(self._item_stages())):
            for i in range(self.length()):
                yield self.item(i)
            return
        i = 0
        while self._walk(i):
            yield self.item(i)
            i += 1

    def at(self, k, twin: int = 0) -> Box:
        if isinstance(k, bool) or not isinstance(k, (int, bytes)):
            raise ExprError("a subscript that is neither integer nor string")
        if not self.sequence():
            raise NotContainerError(f"a subscript of {self.stage.kind}")
        if isinstance(k, bytes):
            return self.item(self.find(k, twin))
        return self.item(k + self.length() if k < 0 else k)

    def keyed(self) -> bool:
        base = self.memo["base"] if self.stage.kind == "slice" else self
        while base.stage.kind == "slice":
            base = base.memo["base"]
        return base.stage.kind == "array" and not base.rt.is_bytes(base.stage) and bool(base._item_stages()[-1].attr("@key"))

    def key_of(self, i: int):
        """The key of the i-th item; the ordinal where items have none."""
        if not self.keyed():
            return i
        return self.key_in(self.item(i))

    def key_in(self, b: Box):
        """The key of an item."""
        return self.rt.value(b.stage.attr("@key")[0].expr, b)

    def find(self, key, twin: int = 0) -> int:
        """Ordinal of the twin-th item with the key. Keys are read once, as far as needed."""
        if not self.keyed():
            raise ExprError("a key of an array without keys")
        m = self.memo
        if "keys" not in m and self.stage.kind == "array" and (d := self.rt.delimited(self.stage)) is not None:
            field, by = d[1].fields[0].name, d[1].attr("@key")[0].expr
            if isinstance(by, Name) and by.name == field and not any(s.name == field for s in d[1].lets):
                found: dict = {}
                for i, piece in enumerate(self._pieces(d[0])):
                    found.setdefault(piece, []).append(i)
                    m["scanned"] = i + 1
                m["keys"] = found
        where = m.setdefault("keys", {})
        i = m.setdefault("scanned", 0)
        while len(where.get(key, ())) <= twin:
            try:
                k = self.key_of(i)
            except NoItemError:
                raise NoItemError(f"no item with the key {key!r}" + ("{%d}" % twin if twin else "")) from None
            where.setdefault(k, []).append(i)
            i = m["scanned"] = i + 1
        return where[key][twin]

    def twin_of(self, i: int) -> int:
        """How many earlier items share the i-th item's key."""
        k = self.key_of(i)
        if not self.keyed():
            return 0
        t = 0
        while self.find(k, t) != i:
            t += 1
        return t

    def twins(self, key) -> list[int]:
        out: list[int] = []
        while True:
            try:
                out.append(self.find(key, len(out)))
            except NoItemError:
                return out

    def slice(self, a: int, b: int) -> Box:
        if self.bytelike():
            src, start, _ = self.output()
            return Box(self.rt, Stage("bslice", None), src, start + a, start + b, container=self)
        base, lo = (self.memo["base"], self.memo["lo"]) if self.stage.kind == "slice" else (self, 0)
        start = base.item(lo + a).root().start if b > a else base.start
        last = base.item(lo + b - 1).root() if b > a else None
        out = Box(self.rt, Stage("slice", None), self.src, start, last.start + last.span() if last else start, container=self)
        out.memo |= {"base": base, "lo": lo + a, "hi": lo + b}
        return out

    def root(self) -> Box:
        b = self
        while b.prev is not None:
            b = b.prev
        return b

    def same(self, other: Box) -> bool:
        """Whether both are views of one array at one place."""
        a, b = self, other
        while a.stage.kind == "slice":
            a = a.memo["base"]
        while b.stage.kind == "slice":
            b = b.memo["base"]
        return a is b or a.stage is b.stage and a.stage.kind == "array" and a.src is b.src and a.start == b.start

    # ------------------------------------------------------------ content
    def output(self) -> tuple[Source, int, int]:
        """What a filter over this box reads."""

        def make():
            k = self.stage.kind
            if k in DECODERS:
                v = self.value()
                if not isinstance(v, bytes):
                    raise ExprError("a filter over a plain value")
                return Source(v), 0, len(v)
            if k == "string":
                return self.src, self.start, self.start + self._string()[0]
            return self.src, self.start, self.start + self.span()

        return self._once("output", make)

    def raw(self) -> bytes:
        """The bytes the box claims."""
        return self.src.data[self.start : self.start + self.span()]

    def value(self):
        """The decoded value; None of structures and arrays."""
        return self._once("value", self._value)

    def _value(self):
        k = self.stage.kind
        if k == "slice" or k in ("struct", "union", "spec") or k == "array" and not self.rt.is_bytes(self.stage):
            return None
        if k == "string":
            return self.src.data[self.start : self.start + self._string()[0]]
        data = self.raw()
        if k == "integer":
            return codecs.integer(data, bool(self.attr("@signed", False)), self.attr("@endian"))
        if k == "varint":
            return codecs.varint(data, self.attr("@endian"))
        if k == "formatted_integer":
            return codecs.formatted_integer(data, self.attr("@base", 10), self.attr("@signed", True), self.attr("@empty_value"))
        if k == "base64":
            return codecs.base64_decode(data)
        if k == "deflate":
            return codecs.inflate(data, self.attr("@output_size"))
        if k == "snappy":
            return codecs.snappy_decode(data)
        if k == "user":
            return _checked(self.stage.node.func().read(memoryview(data)))
        return data

    def location(self) -> tuple[int, int]:
        """(offset, size) in the box's address space."""
        if self.stage.kind in DECODERS:
            v = self.value()
            return 0, len(v) if isinstance(v, bytes) else self.span()
        if self.stage.kind == "string" and self.prev is None:
            return self.start, self._string()[0]  # without the boundary, which the item claims all the same
        return self.start, self.span()

    def deep(self):
        """Nested dicts, lists and values. Of live fields that share a name the last wins."""
        k = self.stage.kind
        if k in ("struct", "union"):
            out: dict = {}
            for f in self.fields():
                b = self.field(f)
                if f.name is not None:
                    out[f.name] = b.deep()
                elif b.stage.kind in ("struct", "union"):
                    out |= b.deep()
            return out
        if k == "slice" or k == "array" and not self.rt.is_bytes(self.stage):
            return [b.deep() for b in self.items()]
        return self.value()


class _Failed:
    def __init__(self, error: Exception):
        self.error = error


_BUSY = object()
_NONE = (-1, None)
