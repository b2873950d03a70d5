"""A session of names over in-memory data: the local counterpart of the Spark session, and what runs inside executors."""

from __future__ import annotations

from ..errors import ExprError, NoDataError, NoItemError
from ..lang.parser import parse_expression
from .box import Box, Data, External, Runtime, Source, TypeVal


class Board:
    def __init__(self) -> None:
        self.rt = Runtime()
        self.specs: dict[str, str] = {}
        self.exprs: dict[str, str] = {}

    def add_data_source(self, name: str, data: bytes) -> None:
        self.rt.bind(name, Data(Source(bytes(data), name)))

    def add_file(self, path: str, data: bytes) -> None:
        self.rt.files[path] = bytes(data)

    def add_spec(self, name: str, text: str) -> None:
        self.rt.bind(name, self.rt.schema(text))
        self.specs[name] = text

    def use_spec(self, text: str) -> None:
        """Make the names of a schema visible without a prefix."""
        spec = self.rt.schema(text)
        for s in spec.lets:
            self.rt.board.lets = [x for x in self.rt.board.lets if x.name != s.name or x.conds] + [s]
        self.rt.flat.clear(), self.rt.found.clear()
        self.specs[""] = text

    def forget_spec(self) -> None:
        self.specs.pop("", None)
        keep = {*self.specs, *self.exprs}
        self.rt.board.lets = [s for s in self.rt.board.lets if s.name in keep or isinstance(s.expr, Data)]
        self.rt.flat.clear(), self.rt.found.clear()

    def register_function(self, name: str, func) -> None:
        self.rt.externals[name] = External(name, func, False)

    def register_filter(self, name: str, cls) -> None:
        self.rt.externals[name] = External(name, cls, True)

    def add_expr(self, name: str, text: str) -> None:
        self.rt.bind(name, parse_expression(text, self.rt.board))
        self.exprs[name] = text

    def remove(self, name: str) -> None:
        self.rt.unbind(name)
        self.specs.pop(name, None)
        self.exprs.pop(name, None)

    def get_spec(self, name: str) -> str:
        if name not in self.specs:
            raise NoItemError(f"no such schema: {name}")
        return self.specs[name]

    def names(self) -> list[str]:
        return sorted({s.name for s in self.rt.board.lets} | set(self.rt.externals))

    def eval(self, text: str, box: Box | None = None):
        """A value, a Box (a place in data), or a TypeVal for an expression that only names a type."""
        return self.rt.evaluate(text, box)

    def read(self, text: str, box: Box | None = None):
        """The expression's value, structures and arrays as dicts and lists."""
        v = self.eval(text, box)
        if isinstance(v, TypeVal):
            raise NoDataError(f"{text} is a type")
        return v.deep() if isinstance(v, Box) else v


def builtin_names(prefix: str = "") -> list[str]:
    from .box import FILTERS, FUNCTIONS

    return sorted(n for n in (*FILTERS, *FUNCTIONS) if n.startswith(prefix))


def evaluate_constant(text: str):
    return Board().read(text)


__all__ = ["Board", "ExprError", "builtin_names", "evaluate_constant"]
