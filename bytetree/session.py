"""Schemas and path expressions over DataFrames.

A `Session` binds names to schemas, to BINARY or STRING columns of DataFrames, and to Python functions and filters.
`Session.eval` compiles an expression on the driver and returns `Items`, from which DataFrames are made:

* where the layout is constant, as built-in Column functions that Catalyst compiles (strategy "catalyst");
* else by numpy for runs of sources at once, in Arrow batches on the executors (`decode.batches`);
* else, and for sources on which anything fails, by the lazy decoder there, box by box (strategy "decoder").
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .decode.board import Board
from .decode.batches import evaluate, own_key, words
from .decode.box import Box, Data, Source, TypeVal
from .decode.vectors import Records, Varints, reader
from .errors import ExprError, NoDataError, NoItemError, PathError, Unsupported
from .lang.ast import Chain, Member, Name, Node, Slice
from .lang.parser import parse_expression
from .operators.nodes import NODE_SCHEMA, node_rows
from .plans import columns as K
from .plans.records import record
from .plans.typing import Place, as_spark, fit, infer, item_of, lazy, plain

MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")
BATCH_ROWS = 2000
DRIVER_ROWS, DRIVER_BYTES = 10_000, 64 << 20  #: of values that come to the driver as Python or YAML
FILES_BYTES = 8 << 20  #: of file contents that every task carries
PIECE_ITEMS = 1 << 16  #: items decoded by numpy at once
RUN_BYTES = 1 << 20  #: of sources evaluated at once
SPREAD_BYTES = 64 << 20  #: a core's share of a scan that is left where it is


@dataclass
class Piece:
    """All items of one source row, undecoded."""

    items: np.ndarray


@dataclass
class Program:
    """What an executor needs to evaluate an expression: texts, registered externals, small constants."""

    expr: str
    source: str
    specs: dict[str, str]
    exprs: dict[str, str]
    externals: dict[str, tuple[object, bool]]
    constants: dict[str, bytes]
    files: dict[str, bytes] = field(default_factory=dict)

    def board(self) -> tuple[Board, Node, Data]:
        b = Board()
        for name, (func, is_filter) in self.externals.items():
            (b.register_filter if is_filter else b.register_function)(name, func)
        for name, data in self.constants.items():
            b.add_data_source(name, data)
        b.rt.files = dict(self.files)
        slot = Data(Source(b""))
        b.rt.bind(self.source, slot)
        for name, text in self.specs.items():
            b.add_spec(name, text) if name else b.use_spec(text)
        for name, text in self.exprs.items():
            b.add_expr(name, text)
        node = parse_expression(self.expr, b.rt.board)
        b.rt.check_names(node)
        return b, node, slot

    def rows(self, board: tuple[Board, Node, Data] | None = None):
        """A function from a row's bytes to the expression's value there."""
        b, node, slot = board or self.board()

        def run(data: bytes):
            slot.source = Source(data)
            v = b.rt.ev(node, None)
            if isinstance(v, TypeVal):
                raise NoDataError("the expression is a type")
            return v

        return run


class Session:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.local = Board()
        self.sources: dict[str, tuple[DataFrame, str]] = {}
        self.constants: dict[str, bytes] = {}
        self.files: dict[str, bytes] = {}

    # ------------------------------------------------------------ names
    def add_spec(self, name: str, text: str) -> None:
        self.local.add_spec(name, text)

    def add_spec_file(self, name: str, path: str) -> None:
        self.add_spec(name, "\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()))

    def use_spec(self, text: str) -> None:
        self.local.use_spec(text)

    def forget_spec(self) -> None:
        self.local.forget_spec()

    def get_spec(self, name: str) -> str:
        return self.local.get_spec(name)

    def add_expr(self, name: str, text: str) -> None:
        self.local.add_expr(name, text)

    def register_function(self, name: str, func) -> None:
        self.local.register_function(name, func)

    def register_filter(self, name: str, cls) -> None:
        self.local.register_filter(name, cls)

    def add_data_source(self, name: str, data: DataFrame | bytes, column: str = "content") -> None:
        """A column of a DataFrame, each row a source of its own, or bytes that every row sees (at most 8 MiB)."""
        if isinstance(data, (bytes, bytearray)):
            if len(data) > 8 << 20:
                raise ExprError("larger data belongs in a DataFrame")
            self.constants[name] = bytes(data)
            self.local.add_data_source(name, bytes(data))
            return
        if column not in data.columns:
            raise ExprError(f"no such column: {column}")
        self.sources[name] = (data, column)
        self.local.rt.bind(name, Data(Source(b"", name)))

    def add_files(self, name: str, path: str) -> None:
        """Each file under path is a row; keys are its path, length and time."""
        self.add_data_source(name, self.spark.read.format("binaryFile").load(path), "content")

    def add_file(self, path: str, data: bytes) -> None:
        """Content for `file { @path: ...; }`, for small lookup files: all together go to every task, so they are at most
        FILES_BYTES. Larger or unknown sets of files are joined: see `open_files`."""
        if sum(map(len, self.files.values())) + len(data) > FILES_BYTES:
            raise ExprError("more file contents than a task may carry; join them with open_files")
        self.files[path] = bytes(data)
        self.local.add_file(path, data)

    def open_files(self, paths: DataFrame, files: DataFrame, on: str = "value") -> DataFrame:
        """The rows of `paths`, with the content of the file that column `on` (binary or text) names, and a status.

        `files` is (path, content), such as `spark.read.format("binaryFile")` gives: the two meet in a join on the path, so any
        number of files of any size can be opened by computed paths. A path is matched whole, or by what follows its scheme.
        """
        plain = lambda c: F.regexp_replace(c, "^[a-z]+:/*(?=/)", "")
        held = files.select(plain(F.col("path")).alias("__path"), F.col("content").alias("content"))
        named = paths.withColumn("__at", plain(F.col(on).cast("binary").cast("string")))
        met = named.join(held, F.col("__at") == F.col("__path"), "left")
        missing = F.col("__at").isNotNull() & F.col("__path").isNull()
        mine = [c for c in paths.columns if c not in ("content", "status")]
        return met.select(*mine, held["content"], F.when(missing, F.lit("no_item")).alias("status"))

    def notify_file_change(self, path: str) -> None:
        self.spark.catalog.refreshByPath(path)

    def remove(self, name: str) -> None:
        self.sources.pop(name, None), self.constants.pop(name, None)
        self.local.remove(name)

    def names(self) -> list[str]:
        return self.local.names()

    def eval(self, expr: str, strategy: str = "auto", mode: str = "PERMISSIVE") -> Items:
        return Items(self, expr, strategy, mode)

    def column(self, expr: str, **names: tuple[Column, str]) -> Column:
        """A scalar expression over columns, as a Column."""
        return K.scalar(expr, names)[0]


class Items:
    """An expression over a source, evaluated for each of its rows when a DataFrame is asked for."""

    def __init__(self, session: Session, expr: str, strategy: str, mode: str):
        if mode not in MODES or strategy not in ("auto", "catalyst", "decoder"):
            raise ExprError(f"no such mode or strategy: {mode}, {strategy}")
        self.session, self.expr, self.mode, self.strategy = session, expr, mode, strategy
        rt = session.local.rt
        self.node = parse_expression(expr, rt.board)
        rt.check_names(self.node)
        used = [n for n in session.sources if _mentions(self.node, n) or any(_mentions(parse_expression(t), n) for t in session.local.exprs.values())]
        if len(used) > 1:
            raise ExprError("an expression reads one DataFrame; join them first")
        self.source = used[0] if used else None
        self.kind = infer(rt, self.node)

    # ------------------------------------------------------------ plans
    def schema(self) -> T.DataType:
        return as_spark(self.session.local.rt, self.kind)

    def item_schema(self) -> T.DataType:
        rt = self.session.local.rt
        return as_spark(rt, item_of(rt, self.kind))

    def layout(self) -> K.Layout | None:
        """The constant record layout of `source <> Type` or `(source <> Type).member`, if it has one."""
        e, name, cuts = self.node, None, []
        while isinstance(e, Slice) and e.start_twin is None and e.stop_twin is None:
            cuts.append((e.start, e.stop))
            e = e.base
        if isinstance(e, Member):
            e, name = e.base, e.name
        if self.source is None or not isinstance(e, Chain) or not isinstance(e.left, Name) or e.left.name != self.source:
            return None
        c = self.session.local.rt.choices(e.right)
        if len(c) != 1:
            return None
        rt = self.session.local.rt
        out = K.member_layout(rt, c[0], name) if name else K.layout_of(rt, c[0])
        for start, stop in reversed(cuts):
            out = K.sliced(out, start, stop) if out is not None else None
        return out

    def delimiter(self) -> K.Delimited | None:
        """How the items of `source <> Type` are delimited, if nothing else makes them up."""
        e = self.node
        if self.source is None or not isinstance(e, Chain) or not isinstance(e.left, Name) or e.left.name != self.source:
            return None
        c = self.session.local.rt.choices(e.right)
        return K.delimited(self.session.local.rt, c[0]) if len(c) == 1 else None

    def _split(self, d: K.Delimited) -> DataFrame:
        df, keys, column = self._input()
        rows = df.select(*keys, F.posexplode(K.split_items(d, F.coalesce(F.col(column).cast("binary"), F.lit(b"")))).alias("ordinal", "item"))
        item = F.encode("item", "ISO-8859-1")
        return rows.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), (F.struct(item.alias(d.field)) if d.field else item).alias("item"))

    def _input(self) -> tuple[DataFrame, list[str], str]:
        if self.source is None:
            df = self.session.spark.createDataFrame([(bytearray(),)], "content binary")
            return df, [], "content"
        df, column = self.session.sources[self.source]
        return df, [c for c in df.columns if c != column], column

    def _program(self) -> Program:
        s = self.session
        ext = {k: (x.func, x.is_filter) for k, x in s.local.rt.externals.items()}
        return Program(self.expr, self.source or "__none", dict(s.local.specs), dict(s.local.exprs), ext, dict(s.constants), dict(s.files))

    def _at_once(self, kind: T.DataType, items: bool) -> bool:
        """Whether the expression is one that numpy evaluates for many sources at once."""
        if self.strategy == "decoder" or self.source is None:
            return False
        try:
            b, node, slot = self._program().board()
            evaluate(b.rt, slot, node, pa.array([], pa.binary()), to_arrow_schema(T.StructType([T.StructField("v", kind)])).field(0).type, items, probe=True)
        except (PathError, RecursionError):
            return False
        return True

    def _map(self, made: T.StructType, each, whole: Records | Varints | None = None, at_once: bool = False) -> DataFrame:
        """Keys and `made` columns: each(run, data) yields tuples for one source row, or a Piece with all its items for `whole` to decode.
        at_once: numpy evaluates runs of sources, and what it leaves is given to `each`."""
        df, keys, column = self._input()
        program, mode = self._program(), self.mode
        src = _spread(df.select(*keys, F.col(column).cast("binary").alias(column)))
        out = T.StructType([*(src.schema[k] for k in keys), *made.fields])
        arrow = to_arrow_schema(T.StructType(made.fields))
        n = len(keys)
        items = made.fieldNames()[0] == "ordinal"

        def runs(board: tuple[Board, Node, Data], batch: pa.RecordBatch, left: list[int]) -> Iterator[pa.RecordBatch]:
            """What numpy gives; the rows it gives nothing for are added to `left`."""
            b, node, slot = board
            kind = arrow.field(1 if items else 0).type
            for first, sources in _runs(batch.column(n)):
                try:
                    got = evaluate(b.rt, slot, node, sources, kind, items)
                except Unsupported:
                    left += range(first, first + len(sources))
                    continue
                left += (got.left + first).tolist()
                if mode == "FAILFAST":
                    left += [first + i for i, _, _ in got.known]
                rows, m = first + got.rows, len(got.rows)
                nulls = [pa.nulls(m, pa.string())] * 2
                yield from made_of(batch, rows, [*([pa.array(got.ordinal)] if items else []), got.values, *nulls])
                if got.known and mode == "PERMISSIVE":
                    rows = np.array([first + i for i, _, _ in got.known])
                    yield from made_of(batch, rows, [pa.nulls(len(rows), kind), *(pa.array([k[j] for k in got.known], pa.string()) for j in (1, 2))])

        def made_of(batch: pa.RecordBatch, rows: np.ndarray, own: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), PIECE_ITEMS):
                kept = _keys_at(batch, n, rows[at : at + PIECE_ITEMS])
                yield pa.RecordBatch.from_arrays([*kept, *(c.slice(at, PIECE_ITEMS) for c in own)], [*batch.schema.names[:n], *arrow.names])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            board = program.board()
            run = program.rows(board)
            for batch in batches:
                which: list[int] | range = range(len(batch))
                if at_once:
                    which = []
                    yield from runs(board, batch, which)
                    which.sort()
                at: list[int] = []
                cols: list[list] = [[] for _ in made.fields]
                held = 0
                pieces: list[tuple[int, np.ndarray]] = []
                piled = 0

                def together():
                    sizes = np.array([len(p) for _, p in pieces])
                    kept = _keys_at(batch, n, np.repeat([i for i, _ in pieces], sizes))
                    number = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    own = [pa.array(number), whole.arrow([p for _, p in pieces], arrow.field(1).type), *(pa.nulls(len(number), f.type) for f in list(arrow)[2:])]
                    return pa.RecordBatch.from_arrays([*kept, *own], [*batch.schema.names[:n], *arrow.names])

                def flush():
                    kept = _keys_at(batch, n, np.array(at, np.int64))
                    made_cols = [pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
                    return pa.RecordBatch.from_arrays([*kept, *made_cols], [*batch.schema.names[:n], *arrow.names])

                for i in which:
                    data = batch.column(n)[i].as_py() or b""
                    try:
                        for row in each(run, data):
                            if isinstance(row, Piece):
                                pieces.append((i, row.items))
                                piled += len(row.items)
                                if piled >= PIECE_ITEMS:
                                    yield together()
                                    pieces, piled = [], 0
                                continue
                            at.append(i)
                            for c, v in zip(cols, row, strict=True):
                                c.append(v)
                            held += 1
                            if held >= BATCH_ROWS:
                                yield flush()
                                at, cols, held = [], [[] for _ in made.fields], 0
                    except PathError as e:
                        if mode == "FAILFAST":
                            raise
                        if mode == "PERMISSIVE" and len(made.fields) > 2:
                            at.append(i)
                            for c, f in zip(cols, made.fields, strict=True):
                                c.append(e.status if f.name == "status" else str(e) if f.name == "message" else None)
                    held += len(data) // 4096
                    if held >= BATCH_ROWS:
                        yield flush()
                        at, cols, held = [], [[] for _ in made.fields], 0
                if at:
                    yield flush()
                if piled:
                    yield together()

        return src.mapInArrow(work, out)

    # ------------------------------------------------------------ results
    def df(self) -> DataFrame:
        """Keys, value, status and message: one row for each source row. In a structure, members that fail are null."""
        kind = self.schema()
        if self.strategy != "decoder" and isinstance(self.node, Chain) and self._whole(self.node) and len(c := self.session.local.rt.choices(self.node.right)) == 1:
            df, keys, column = self._input()
            value = record(self.session.local.rt, c[0], F.col(column).cast("binary"), kind)
            if value is not None:
                none = F.lit(None).cast("string")
                return df.select(*keys, value.alias("value"), none.alias("status"), none.alias("message"))
        made = T.StructType([T.StructField("value", kind), T.StructField("status", T.StringType()), T.StructField("message", T.StringType())])

        def each(run, data):
            v = run(data)
            yield (lazy(v, kind) if isinstance(v, Box) else fit(v, kind)), None, None

        return self._map(made, each, at_once=self._at_once(kind, False))

    def rows(self) -> DataFrame:
        """Keys, ordinal and item: one row for each item of an array, in storage order within a source row.

        The catalyst strategy makes the ordinals first and decodes after, so one large source can be repartitioned in between,
        and members that nobody selects are not decoded.
        """
        layout = self.layout() if self.strategy != "decoder" else None
        if layout is not None:
            return self._catalyst(layout)
        split = self.delimiter() if self.strategy != "decoder" else None
        if split is not None:
            return self._split(split)
        if self.strategy == "catalyst":
            raise ExprError("the layout isn't constant")
        kind, whole = self.item_schema(), self._vectors()
        made = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("item", kind), T.StructField("status", T.StringType()), T.StructField("message", T.StringType())])
        mode = self.mode

        def each(run, data):
            v = run(data)
            if not isinstance(v, Box) or not v.sequence():
                raise NoItemError("the expression isn't a sequence")
            if whole is not None and (piece := whole.take(v)) is not None:
                yield Piece(piece)
                return
            for i, b in enumerate(v.items()):
                try:
                    yield i, lazy(b, kind), None, None
                except PathError as e:
                    if mode == "FAILFAST":
                        raise
                    if mode == "PERMISSIVE":
                        yield i, None, e.status, str(e)

        return self._map(made, each, whole, whole is None and self._at_once(kind, True))

    def _vectors(self) -> Records | Varints | None:
        """How the items are read at once by numpy, if they are."""
        k = self.kind
        if not isinstance(k, Place) or k.last.kind != "array":
            return None
        rt = self.session.local.rt
        return reader(rt, rt.item_stages(k.last), rt.array_of(k.last).length is not None, K.leaves_of) if not rt.is_bytes(k.last) else None

    def _catalyst(self, layout: K.Layout) -> DataFrame:
        df, keys, column = self._input()
        data, rt = F.col(column).cast("binary"), self.session.local.rt
        src = df.select(*keys, data.alias(column))
        x = K.extent(rt, layout, F.col(column))
        numbers = F.when(x.n > 0, F.sequence(F.lit(0), x.n - 1)).otherwise(F.array().cast("array<int>"))
        if not layout.sure:
            src = src.select("*", x.first.cast("long").alias("__first"), x.status.alias("__status"), x.message.alias("__message"))
            if self.mode == "PERMISSIVE":
                numbers = F.when(F.col("__status").isNull(), numbers).otherwise(F.concat(numbers, F.array(F.lit(None).cast("int"))))
            elif self.mode == "FAILFAST":
                numbers = F.when(F.col("__status").isNull(), numbers).otherwise(F.raise_error(F.col("__message")).cast("array<int>"))
        rows = src.withColumn("ordinal", F.explode(numbers))
        first = F.lit(0).cast("long") if layout.sure else F.col("__first")
        at = (F.col("ordinal") + first) * F.lit(layout.width) + F.lit(layout.head)
        item = K.assemble(rt, layout.leaves, F.col(column), at.cast("int"))
        out = [*keys, F.col("ordinal").cast("long").alias("ordinal")]
        if layout.sure:
            return rows.select(*out, item.alias("item"))
        bad = F.col("ordinal").isNull()
        return rows.select(*out, F.when(~bad, item).alias("item"), F.when(bad, F.col("__status")).alias("status"), F.when(bad, F.col("__message")).alias("message"))

    def _constant_nodes(self) -> DataFrame | None:
        """The node table without Python, of an array of unkeyed records of constant layout that is all there is in its source."""
        e, rt = self.node, self.session.local.rt
        layout = self.layout()
        name = e.name if isinstance(e, Member) else None
        top = None
        if layout is None and isinstance(e, Chain) and len(c := rt.choices(e.right)) == 1 and c[0][-1].kind == "struct":
            block = c[0][-1].block
            if len(block.fields) == 1 and block.fields[0].name is not None:
                layout, top = K.member_layout(rt, c[0], block.fields[0].name) if len(c[0]) == 1 and self._whole(e) else None, (1, block.fields[0].name)
                stages = rt.choices(block.fields[0].expr)[0]
        elif layout is not None and not isinstance(e, Slice):
            c = rt.choices((e.base if name else e).right)[0]
            stages = rt.choices(next(f for f in c[-1].block.fields if f.name == name).expr)[0] if name else c
        if layout is None or isinstance(e, Slice) or not layout.sure or layout.count is not None or layout.head or layout.tail:
            return None
        items = rt.item_stages(stages[0])[0]
        if items[-1].attr("@key"):
            return None
        df, keys, column = self._input()
        src = df.select(*keys, F.col(column).cast("binary").alias(column))
        n = K.extent(rt, layout, F.col(column)).n
        rows = src.select("*", n.alias("__n"), F.explode(F.sequence(F.lit(-1), n - 1)).alias("__i"))
        nodes = K.node_columns(rt, layout, items, top, F.col(column), F.col("__i"), F.col("__n"), NODE_SCHEMA)
        return rows.select(*keys, F.explode(nodes).alias("__node")).select(*keys, "__node.*")

    def _word_nodes(self) -> DataFrame | None:
        """The node table down to depth 1 of items that end at a byte: numpy finds them for runs of sources, and Catalyst makes the
        columns that are asked for."""
        if self.delimiter() is None:
            return None
        rt = self.session.local.rt
        edge, block = rt.delimited(rt.choices(self.node.right)[0][0])
        keyed = own_key(block) is not None
        if len(edge) != 1 or block is not None and block.attr("@key") and not keyed:
            return None
        df, keys, column = self._input()
        program, n = self._program(), len(keys)
        src = _spread(df.select(*keys, F.col(column).cast("binary").alias(column)))
        found = T.StructType([T.StructField(k, t) for k, t in (("__i", T.LongType()), ("__n", T.LongType()), ("__twin", T.IntegerType()), ("__at", T.LongType()), ("__size", T.LongType()), ("__v", T.BinaryType()))])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, node, slot = program.board()
            stage = b.rt.choices(node.right)[0][0]
            for batch in batches:
                names = [*batch.schema.names[:n], *found.fieldNames()]
                for first, sources in _runs(batch.column(n)):
                    w = words(b.rt, slot, stage, sources)
                    m = len(sources)
                    tops = [pa.array(np.full(m, -1)), pa.array(w.counts), pa.nulls(m, pa.int32()), pa.array(np.zeros(m, np.int64)), pa.array(w.sizes), pa.nulls(m, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, m).columns[:n], *tops], names)
                    items = [pa.array(w.ordinal), pa.nulls(len(w.own), pa.int64()), pa.array(w.twin), pa.array(w.offset), pa.array(w.size), w.text]
                    for at in range(0, len(w.own), PIECE_ITEMS):
                        kept = _keys_at(batch, n, first + w.own[at : at + PIECE_ITEMS])
                        yield pa.RecordBatch.from_arrays([*kept, *(c.slice(at, PIECE_ITEMS) for c in items)], names)

        rows = src.mapInArrow(work, T.StructType([*(src.schema[k] for k in keys), *found.fields]))
        i, v, top = F.col("__i"), F.col("__v"), F.col("__i") < 0
        none = F.lit(None)
        text = F.decode(v, "ISO-8859-1")
        simple = F.contains(text, F.lit('"')) & ~F.contains(text, F.lit("'"))
        quoted = F.when(simple, F.concat(F.lit("'"), text, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
        rank = F.when(F.col("__twin") > 0, F.concat(F.lit("{"), F.col("__twin").cast("string"), F.lit("}"))).otherwise("")
        cols = {
            "node_id": i + 1, "parent_id": F.when(~top, F.lit(0)), "depth": F.when(top, F.lit(0)).otherwise(F.lit(1)), "ordinal": F.greatest(i, F.lit(0).cast("long")),
            "dpath": F.when(top, F.lit("")).otherwise(F.concat(F.lit("["), F.concat(quoted, rank) if keyed else i.cast("string"), F.lit("]"))),
            "filter": F.when(top, F.lit("array")).otherwise(F.lit("struct" if block is not None else "string")), "key_bin": v if keyed else none, "twin": F.col("__twin") if keyed else none,
            "space_id": F.lit(0), "offset": F.col("__at"), "size": F.col("__size") if block is not None else F.when(top, F.col("__size")).otherwise(F.length(v)),
            "n_items": F.when(top, F.col("__n")).otherwise(F.lit(1) if block is not None else F.length(v)), "v_bin": none if block is not None else v,
        }
        return rows.select(*keys, *(cols.get(f.name, none).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA.fields))

    def _whole(self, e: Chain) -> bool:
        return self.source is not None and isinstance(e.left, Name) and e.left.name == self.source

    def nodes(self, depth: int | None = None) -> DataFrame:
        """The node table: one row for each box below the expression, down to `depth` if one is given, in preorder (columns: NODE_SCHEMA)."""
        found = self._constant_nodes() if self.strategy != "decoder" and depth is None else None
        if found is None and self.strategy != "decoder" and depth == 1:
            found = self._word_nodes()
        if found is not None:
            return found

        def each(run, data):
            v = run(data)
            if not isinstance(v, Box):
                raise ExprError("a plain value has no nodes")
            yield from node_rows(v, depth)

        return self._map(NODE_SCHEMA, each)

    def json(self) -> DataFrame:
        """Keys and the value as JSON text, a character for each byte."""
        return self.text("json")

    def text(self, form: str) -> DataFrame:
        """Keys and the value as text in column `form`: json and yaml (a character for each byte), or python (a literal)."""
        made = T.StructType([T.StructField(k, T.StringType()) for k in (form, "status", "message")])
        return self._map(made, lambda run, data: [(_FORMS[form](_deep(run(data))), None, None)])

    def raw(self) -> DataFrame:
        """Keys and the bytes the expression's filters give."""
        made = T.StructType([T.StructField("raw", T.BinaryType()), T.StructField("status", T.StringType()), T.StructField("message", T.StringType())])

        def each(run, data):
            v = run(data)
            if isinstance(v, Box):
                src, a, b = v.output()
                v = src.data[a:b]
            yield v if isinstance(v, bytes) else str(v).encode(), None, None

        return self._map(made, each)

    def hexdump(self, width: int = 16) -> DataFrame:
        """Keys and one row for each line of a hex dump: offset in the address space, hex pairs, text."""
        raw = self.raw()
        keys = [c for c in raw.columns if c not in ("raw", "status", "message")]
        lines = raw.filter("length(raw) > 0").select(*keys, "raw", F.explode(F.sequence(F.lit(0), F.expr(f"(length(raw) - 1) div {width}"))).alias("line"))
        piece = F.substring(F.col("raw"), F.col("line") * width + 1, F.lit(width))
        text = F.regexp_replace(F.decode(piece, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
        return lines.select(*keys, (F.col("line") * width).cast("long").alias("offset"), F.trim(F.regexp_replace(F.hex(piece), "(..)", "$1 ")).alias("hex"), text.alias("text"))

    def python(self) -> list:
        """The values of all rows on the driver: dicts, lists, ints, booleans, text with a character for each byte. At most
        DRIVER_ROWS rows of DRIVER_BYTES together; `text` gives larger results as a DataFrame."""
        return [json.loads(t) for t in self._few("json")]

    def yaml(self) -> str:
        """All rows as YAML documents on the driver, within the bounds of `python`."""
        return "".join(f"---\n{t}" for t in self._few("yaml"))

    def _few(self, form: str) -> list[str]:
        rows = self.text(form).filter(F.col(form).isNotNull()).select(form).limit(DRIVER_ROWS + 1).persist()
        try:
            n, size = rows.agg(F.count("*"), F.sum(F.octet_length(form))).first()
            if n > DRIVER_ROWS or (size or 0) > DRIVER_BYTES:
                raise ExprError("too much for the driver: use text()")
            return [r[0] for r in rows.collect()]
        finally:
            rows.unpersist()


def _runs(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, its sources) of runs of at most RUN_BYTES, or of one source that is larger."""
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + RUN_BYTES, side="right")))
        yield first, column.slice(first, stop - first)
        first = stop


def _keys_at(batch: pa.RecordBatch, n: int, rows: np.ndarray) -> list[pa.Array]:
    """The first n columns, at the rows; sources are never copied for their items."""
    at = pa.array(rows)
    return [c.take(at) for c in batch.columns[:n]]


def _yaml(v) -> str:
    import yaml

    return yaml.safe_dump(plain(v), default_flow_style=False, sort_keys=False)


_FORMS = {"json": lambda v: json.dumps(plain(v)), "yaml": _yaml, "python": repr}


def _spread(df: DataFrame) -> DataFrame:
    """df, dealt out where it is a bare scan of fewer files than there are cores: decoding costs more than moving few rows.
    Inputs with a shuffle of their own are left to adaptive execution, large files to the scan's own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or not (files := df.inputFiles()) or len(files) >= cores or _shuffles(df._jdf.queryExecution().analyzed()):
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SPREAD_BYTES else df


def _shuffles(plan) -> bool:
    """Whether a logical plan aggregates, joins, sorts or deals rows out."""
    names = ("Aggregate", "Join", "Sort", "Repartition", "RepartitionByExpression", "Distinct", "Window", "Deduplicate", "RebalancePartitions")
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() in names:
            return True
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return False


def _deep(v):
    return v.deep() if isinstance(v, Box) else v


def _mentions(node: Node, name: str) -> bool:
    from .decode.box import _walk

    return any(isinstance(n, Name) and n.name == name for n in _walk(node))
