"""Items of small, local data on the driver, with the manners of Python values.

An `Item` is a place in data: attributes and subscripts lead on, `len`, iteration, comparison, arithmetic and `bytes` go to what is
there. A `Spec` is a schema whose names are attributes. Large data belongs in a `Session`.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

from .decode.board import Board
from .decode.box import Box, TypeVal
from .errors import ExprError, NoDataError, NoItemError
from .lang.ast import Block
from .operators.nodes import format_key


def read(board: Board, expr: str):
    """The expression's value, or an Item where it is a place in data that holds more."""
    return _wrap(board, board.eval(expr))


def _wrap(board: Board, v):
    if isinstance(v, TypeVal):
        raise NoDataError("the expression is a type")
    return Item(board, v) if isinstance(v, Box) else v


class Item:
    def __init__(self, board: Board, box: Box):
        self._board, self._box = board, box

    # ------------------------------------------------------------ leading on
    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return _wrap(self._board, self._box.member(name))
        except NoItemError as e:
            raise AttributeError(name) from e

    def __getitem__(self, key):
        """x[3], x["key"], x[("key",)], x[("key", 2)] (the third twin), x[("key", "*")] (all twins), x["member"], x[1:3].

        A bare integer is an ordinal, also where items have integer keys; in a tuple it is a key. Slices are clamped, have no step,
        and are empty where they end before they start.
        """
        b = self._box
        if isinstance(key, slice):
            if key.step not in (None, 1):
                raise ExprError("a slice has no step")
            a, z, _ = key.indices(b.length())
            return Item(self._board, b.slice(a, max(a, z)))
        if isinstance(key, tuple):
            name, twin = (key[0], key[1] if len(key) > 1 else 0)
            name = name.encode() if isinstance(name, str) else name
            if twin == "*":
                return [Item(self._board, b.item(i)) for i in b.twins(name)]
            return Item(self._board, b.item(b.find(name, twin)))
        if isinstance(key, str) and b.stage.kind in ("struct", "union"):
            return _wrap(self._board, b.member(key))
        return Item(self._board, b.at(key.encode() if isinstance(key, str) else key))

    def eval_expr(self, expr: str):
        return _wrap(self._board, self._board.eval(expr, self._box))

    # ------------------------------------------------------------ what is there
    @property
    def value(self):
        """Plain Python: dicts, lists, integers, booleans, bytes."""
        return self._box.deep()

    def get_size(self) -> int:
        return self._box.location()[1]

    def get_offset(self) -> int:
        return self._box.location()[0]

    def get_location(self) -> tuple[int, int]:
        return self._box.location()

    def get_filter_type(self) -> str:
        return self._box.stage.kind

    def __len__(self) -> int:
        return self._box.length()

    def __bool__(self) -> bool:
        v = self._box.value()
        return bool(v) if v is not None else self._box.length() > 0

    def __bytes__(self) -> bytes:
        src, a, b = self._box.output()
        return src.data[a:b]

    def __buffer__(self, flags: int) -> memoryview:
        return memoryview(bytes(self))

    def __str__(self) -> str:
        v = self.value
        return v.decode("latin-1") if isinstance(v, bytes) else str(v)

    def __repr__(self) -> str:
        return f"<{self.get_filter_type()} at {self.get_location()}>"

    def _named(self) -> list[str]:
        return [f.name for f in self._box.fields() if f.name is not None]

    def __iter__(self) -> Iterator:
        """Names of a structure's members, or the items of an array."""
        if self._box.stage.kind in ("struct", "union"):
            return iter(self._named())
        return (Item(self._board, b) for b in self._box.items())

    def iter_keys(self) -> Iterator:
        b = self._box
        if b.stage.kind in ("struct", "union"):
            yield from self._named()
            return
        seen: dict = {}
        for i, x in enumerate(b.items()):
            if not b.keyed():
                yield i
                continue
            k = b.key_in(x)
            yield IndexKey(k, seen.get(k, 0))
            seen[k] = seen.get(k, 0) + 1

    def iter_values(self) -> Iterator:
        for k in self._named() if self._box.stage.kind in ("struct", "union") else ():
            yield self[k]
        if self._box.stage.kind not in ("struct", "union"):
            yield from self

    def iter_items(self) -> Iterator[tuple]:
        return zip(self.iter_keys(), self.iter_values(), strict=True)

    # ------------------------------------------------------------ comparison and numbers
    def _plain(self):
        v = self._box.value()
        return self.value if v is None else v

    def __eq__(self, other) -> bool:
        return self._plain() == _plain(other)

    def __hash__(self) -> int:
        v = self._plain()
        return hash(v) if not isinstance(v, (dict, list)) else id(self)

    def __int__(self) -> int:
        return int(self._plain())

    __index__ = __int__

    def __float__(self) -> float:
        return float(self._plain())


def _plain(v):
    v = v._plain() if isinstance(v, Item) else v
    return v.encode() if isinstance(v, str) else v


for _n in ("lt", "le", "gt", "ge"):
    setattr(Item, f"__{_n}__", lambda a, b, f=getattr(operator, f"__{_n}__"): f(a._plain(), _plain(b)))
for _n in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "lshift", "rshift", "and", "or", "xor"):
    _f = getattr(operator, f"__{_n}__")
    setattr(Item, f"__{_n}__", lambda a, b, f=_f: f(a._plain(), _plain(b)))
    setattr(Item, f"__r{_n}__", lambda a, b, f=_f: f(_plain(b), a._plain()))
for _n in ("neg", "pos", "abs", "invert"):
    setattr(Item, f"__{_n}__", lambda a, f=getattr(operator, f"__{_n}__"): f(a._plain()))
Item.__divmod__ = lambda a, b: divmod(a._plain(), _plain(b))
Item.__rdivmod__ = lambda a, b: divmod(_plain(b), a._plain())


class IndexKey:
    """A key and its rank among equal ones, written key{rank} where the rank isn't zero."""

    def __init__(self, key, twin: int = 0):
        self.key, self.twin = key, twin

    def __str__(self) -> str:
        return format_key(self.key, self.twin) if isinstance(self.key, bytes) else f"{self.key}" + (f"{{{self.twin}}}" if self.twin else "")

    __repr__ = __str__

    def __eq__(self, other) -> bool:
        return (self.key, self.twin) == ((other.key, other.twin) if isinstance(other, IndexKey) else (other.encode() if isinstance(other, str) else other, 0))

    def __hash__(self) -> int:
        return hash((self.key, self.twin))


class Spec:
    """A schema, or a type in it: its names are attributes and subscripts, and iterating gives them."""

    def __init__(self, board: Board, name: str):
        self._board, self._path = board, name
        node = board.rt.evaluate(name)
        if not isinstance(node, TypeVal):
            raise ExprError(f"{name} isn't a type")
        choices = [] if isinstance(node.node, Block) else board.rt.choices(node.node)
        self._block = node.node if isinstance(node.node, Block) else choices[0][-1].block if choices else None

    def __getattr__(self, name: str) -> Spec:
        if name.startswith("__") or name not in list(self):
            raise AttributeError(name)
        return Spec(self._board, f"{self._path}.{name}")

    def __getitem__(self, name: str) -> Spec:
        try:
            return getattr(self, name)
        except AttributeError:
            raise KeyError(name) from None

    def __iter__(self) -> Iterator[str]:
        return iter([s.name for s in (self._block.lets if self._block is not None else [])])

    def members(self) -> list[str]:
        """Names of the fields of a structure."""
        return [f.name for f in (self._block.fields if self._block is not None else []) if f.name]

    def __repr__(self) -> str:
        return f"<type {self._path}>"
