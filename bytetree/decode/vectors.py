"""Arrays of constant layout, and of varints, decoded by numpy for many sources at once. No Spark here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .box import Box, Runtime, Stage

GROUPS = 9  #: seven-bit groups of the longest varint decoded here


def extent(v) -> tuple[Box, int, int] | None:
    """(array, first item, number of items) of a box that is an array or a slice of one."""
    if not isinstance(v, Box) or v.stage.kind not in ("array", "slice"):
        return None
    base, lo = (v.memo["base"], v.memo["lo"]) if v.stage.kind == "slice" else (v, 0)
    return (base, lo, v.length()) if base.stage.kind == "array" else None


class Records:
    """Items of `width` bytes, whose members lie at the places that `leaves` (path, offset, width, chain) name."""

    def __init__(self, rt: Runtime, width: int, leaves: list):
        self.rt, self.width, self.leaves = rt, width, leaves

    def take(self, v) -> np.ndarray | None:
        """The items' bytes, or None where they don't lie whole in their source."""
        found = extent(v)
        if found is None:
            return None
        base, lo, n = found
        at = base.start + lo * self.width
        data = base.src.data
        if at + n * self.width > min(base.stop, len(data)):
            return None
        return np.frombuffer(data, np.uint8, n * self.width, at).reshape(n, self.width)

    def arrow(self, pieces: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        return self._nest(np.concatenate(pieces), self.leaves, kind, 0)

    def _nest(self, rows: np.ndarray, leaves: list, kind: pa.DataType, depth: int) -> pa.Array:
        if len(leaves) == 1 and len(leaves[0].path) == depth:
            return self._leaf(rows[:, leaves[0].offset : leaves[0].offset + leaves[0].width], leaves[0].chain[-1])
        cols = [self._nest(rows, [x for x in leaves if x.path[depth] == f.name], f.type, depth + 1) for f in kind]
        return pa.StructArray.from_arrays(cols, fields=list(kind))

    def _leaf(self, cells: np.ndarray, last: Stage) -> pa.Array:
        cells = np.ascontiguousarray(cells)
        n, w = cells.shape
        if last.kind == "integer":
            little = self.rt._attr_const(last, "@endian") == b"little"
            signed = bool(self.rt._attr_const(last, "@signed"))
            return pa.array(cells.reshape(-1).view(f"{'<' if little else '>'}{'i' if signed else 'u'}{w}").astype(np.int64))
        edge = self.rt._attr_const(last, "@boundary") if last.kind == "string" else None
        sizes = np.full(n, w)
        if edge and w:
            hit = cells == edge[0]
            sizes = np.where(hit.any(1), hit.argmax(1), w)
            cells = cells[np.arange(w) < sizes[:, None]]
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(cells.tobytes())])


class Varints:
    """Bare little-endian varints up to the end of their array."""

    def take(self, v) -> np.ndarray | None:
        if not isinstance(v, Box) or v.stage.kind != "array":
            return None
        data = np.frombuffer(v.src.data, np.uint8, v.stop - v.start, v.start)
        if not len(data):
            return np.empty(0, np.int64)
        ends = np.flatnonzero(data < 128)
        if not len(ends) or ends[-1] != len(data) - 1:
            return None
        starts = np.r_[0, ends[:-1] + 1]
        sizes = ends + 1 - starts
        if sizes.max() > GROUPS:
            return None
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        parts = (data & np.uint8(127)).astype(np.int64) << (7 * place)
        return np.add.reduceat(parts, starts)

    @staticmethod
    def arrow(pieces: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        return pa.array(np.concatenate(pieces), kind)


def reader(rt: Runtime, items: list[list[Stage]], counted: bool, leaves_of: Callable) -> Records | Varints | None:
    """How an array of such items is read at once, if it is."""
    if len(items) != 1 or rt.last_attr(items[0]):
        return None
    chain = items[0]
    if [s.kind for s in chain] == ["varint"]:
        return None if counted or chain[0].attr("@endian") else Varints()
    width, leaves = rt.fixed_size(chain[0]), leaves_of(rt, chain)
    if not width or not leaves or any(len(rt._attr_const(x.chain[-1], "@boundary") or b"x") != 1 for x in leaves if x.chain[-1].kind == "string"):
        return None
    return Records(rt, width, leaves)
