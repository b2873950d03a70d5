"""Runs of sources evaluated by numpy against the box-by-box decoder: the same values, statuses and messages, on whole, cut and empty sources."""

import random

import pytest
from pyspark.sql import functions as F

import bytetree.session as S
from bytetree.operators.index import by_index, nearest_mark, write_key_index, write_offset_index
from bytetree.operators.nodes import by_key, next_with_key
from bytetree.session import Session
from bytetree.sources import work_folder

SPEC = """
let U = integer { @signed: false; @endian: 'big'; };  let L = integer { @signed: true; @endian: 'little'; };
let u8 = byte <> U;  let s8 = byte <> integer { @signed: true; };  let u16 = [2] byte <> U;
let Sized = struct { size: u8; data: [size] byte; };
let Counted = struct { n: u8; items: [n] Sized; tail: [] byte; };
let Greedy = struct { head: byte; items: [] Sized; };
let Mixed = [] struct { a: [2] byte <> integer { @signed: false; @endian: 'native'; }; b: varint { @endian: 'big'; }; c: varint; };
let Last = struct { n: u8; p: u16; @last: n == 46; };
let Until = struct { items: [] Last; rest: [] byte; };
let Capped = struct { items: [3] Last; };
let Flat = struct { items: [] struct { n: s8; p: u16; }; };
let Self = struct { n: u8; sizes: [n] u8; parts: [n] Part; let Part = struct { data: [sizes[index(parts, self)]] byte; }; };
let Order = struct { key: u8; lines: [] Line; let Line = struct { n: u8; p: u8; let ?id = Order::key * 10 + n; }; let ?first = lines[0].?id; };
let Page = struct { id: u16; lacing: struct { n: u8; values: [n] u8; }; body: [len(lacing.values)] Lace;  let Lace = struct { @span: Page::lacing.values[index(Page::body, self)]; packet: [] byte; }; };
let Pages = struct { pages: [] Page; };
let Texts = struct { n: u8; t: [n] string { @boundary: '.'; }; rest: [] byte; };
let Bare = [] string { @boundary: '.'; };
let Words = [] struct { word: string { @boundary: '.'; }; @key: word; };
let Free = [] struct { word: string { @boundary: '.'; }; };
"""


def blobs(n=400):
    r = random.Random(8)
    out = [b"", b"\x00", b"\x80", b".", b"..", b"\x01\x02", bytes(range(1, 46)), b"\x03\x01a\x02bc\x00zz", b"\x02\x01\x02abcd", b"a.'.\".a.\\.'\".a.\xff.a"]
    for k in range(n):
        kinds = ((0, 1, 2, 3, 46), (46, 97, 98), tuple(range(256)), (1, 2, 128, 255))[k % 4]
        out.append(bytes(r.choice(kinds) for _ in range(r.randrange(0, 40))))
    return out


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    s.add_spec("X", SPEC)
    rows = [(i, bytearray(b)) for i, b in enumerate(blobs())] + [(-1, None)]
    s.add_data_source("d", spark.createDataFrame(rows, "k long, content binary").repartition(2))
    return s


def told(df, order):
    return sorted((str(r) for r in df.select(*sorted(df.columns)).collect()), key=str) if order is None else [str(r) for r in df.orderBy(*order).collect()]


ROWS = ["(d <> X.Counted).items", "(d <> X.Greedy).items", "d <> X.Mixed", "(d <> X.Until).items", "(d <> X.Capped).items", "(d <> X.Self).parts", "(d <> X.Order).lines[0..2]", "(d <> X.Pages).pages", "(d <> X.Texts).t"]
VALUES = [
    "len((d <> X.Until).items) * 100 + len((d <> X.Until).rest)", "len((d <> X.Capped).items)", "(d <> X.Flat).items[-1].p", "(d <> X.Flat).items[1].n / (d <> X.Flat).items[0].n", "&(d <> X.Flat).items[-2].p",
    "sizeof (d <> X.Flat).items + sizeof(X.Last)", "sizeof (d <> X.Greedy).items", "index((d <> X.Flat).items, (d <> X.Flat).items[-1])", "(d <> X.Order).?first", "(d <> X.Order).lines[-1].?id",
    "(d <> X.Counted).items[1].data", "(d <> X.Counted).items[-1].size", "(d <> X.Counted).items[-1].size << 60 | 3", "len((d <> X.Counted).tail)", "(d <> X.Pages).pages[1].body[0].packet", "(d <> X.Order).key > 2 && (d <> X.Order).lines[1].n != 3",
    "index(d <> X.Words, (d <> X.Words)[1..]['a'{1}])", "(d <> X.Words)['b'].word", "&(d <> X.Words)['a'{2}]", "len((d <> X.Words)[2..-1])", "d <> X.Sized", "(d <> X.Texts).t[-1]", "(d <> X.Greedy).items[2..].self", "len(d <> X.Bare)",
]
AT_ONCE = {*ROWS, *VALUES} - {"(d <> X.Greedy).items[2..].self", "(d <> X.Order).lines[0..2]"}


@pytest.mark.parametrize("run", [40, 2 << 20])
@pytest.mark.parametrize("mode", ["PERMISSIVE", "DROPMALFORMED"])
@pytest.mark.parametrize("expr", ROWS)
def test_items_are_those_of_boxes(session, monkeypatch, expr, mode, run):
    monkeypatch.setattr(S, "RUN_BYTES", run)
    got, want = session.eval(expr, mode=mode), session.eval(expr, "decoder", mode)
    assert told(got.rows(), ["k", "ordinal"]) == told(want.rows(), ["k", "ordinal"])


@pytest.mark.parametrize("mode", ["PERMISSIVE", "DROPMALFORMED"])
@pytest.mark.parametrize("expr", VALUES)
def test_values_are_those_of_boxes(session, expr, mode):
    got, want = session.eval(expr, mode=mode), session.eval(expr, "decoder", mode)
    assert told(got.df(), ["k"]) == told(want.df(), ["k"])


@pytest.mark.parametrize("expr", sorted(AT_ONCE))
def test_which_are_evaluated_at_once(session, expr):
    items = expr in ROWS
    i = session.eval(expr)
    assert i._at_once(i.item_schema() if items else i.schema(), items)


@pytest.mark.parametrize("expr", ["d <> X.Bare", "d <> X.Words", "d <> X.Free"])
def test_word_nodes_are_those_of_boxes(session, expr, monkeypatch):
    for run in (50, 2 << 20):
        monkeypatch.setattr(S, "RUN_BYTES", run)
        got, want = session.eval(expr).nodes(1), session.eval(expr, "decoder").nodes(1)
        assert got.dtypes == want.dtypes and told(got, ["k", "node_id"]) == told(want, ["k", "node_id"])


def test_one_run_of_many_sources_asks_boxes_for_few(spark, monkeypatch):
    """What numpy can't answer is all that boxes are asked for."""
    from bytetree.decode.batches import evaluate
    import pyarrow as pa

    s = Session(spark)
    s.add_spec("X", SPEC)
    s.add_data_source("d", spark.createDataFrame([(1, bytearray(b""))], "k long, content binary"))
    data = [b"\x02\x01a\x02bc!"] * 1000 + [b"\x05\x01a"]
    b, node, slot = s.eval("(d <> X.Counted).items")._program().board()
    got = evaluate(b.rt, slot, node, pa.array(data, pa.binary()), pa.struct([("size", pa.int64()), ("data", pa.binary())]), True)
    assert got.left.tolist() == [1000] and len(got.rows) == 2000 and got.ordinal[:4].tolist() == [0, 1, 0, 1]
    assert got.values[3].as_py() == {"size": 2, "data": b"bc"}
    b, node, slot = s.eval("len((d <> X.Capped).items)")._program().board()
    got = evaluate(b.rt, slot, node, pa.array([b"\x01\x00\x00", b"\x2e\x00\x00"], pa.binary()), pa.int64(), False)
    assert not len(got.left) and got.known == [(0, "out_of_bounds", "3 bytes where 0 are left")] and got.values.to_pylist() == [1]


def test_next_with_key_is_one_join_on_ranks(spark):
    s = Session(spark)
    s.add_spec("X", SPEC + "let Ints = [] struct { n: u8; @key: n; };")
    s.add_data_source("d", spark.createDataFrame([(1, bytearray(b"a.b.a.a.b")), (2, bytearray(b"b.a"))], "k long, content binary"))
    n = s.eval("d <> X.Words").nodes(1)
    after = next_with_key(n, n.filter("ordinal in (0, 2) and depth = 1"), ["k"])
    assert [(r.k, r.ordinal) for r in after.orderBy("k", "ordinal").collect()] == [(1, 2), (1, 3)] and after.columns == n.columns
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan
    n = s.eval("d <> X.Ints").nodes(1)
    assert [(r.k, r.ordinal) for r in next_with_key(n, by_key(n, 46), ["k"]).collect()] == [(1, 3)]


def test_key_index_deals_a_common_key_to_several_files(spark):
    """One key in most items was one task and one file, however large."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        s = Session(spark)
        s.add_spec("X", SPEC)
        s.add_data_source("d", spark.range(0, 400, 1, 8).selectExpr("id k", "cast(concat(repeat('the.', 500), id) as binary) content"))
        path = work_folder(spark, "key-index-test")
        write_key_index(s.eval("d <> X.Words").nodes(1), path, ["k"])
        per = [r[1] for r in by_index(spark, path, b"the", None).groupBy(F.input_file_name()).count().collect()]
        assert sum(per) == 200_000 and len(per) > 3 and max(per) < 100_000
        assert by_index(spark, path, b"7").select("k", "ordinal", "twin").collect() == [(7, 500, 0)]
        write_offset_index(s.eval("d <> X.Words").nodes(1), path + "-o", ["k"])
        assert nearest_mark(spark, path + "-o", 70).filter("k = 7").select("offset", "ahead").collect() == [(256, 6)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_run_leaves_nothing_to_the_collector(spark):
    """Columns refer to each other; the arrays of many runs piled up until cycles were collected."""
    import gc

    import pyarrow as pa

    from bytetree.decode.batches import Column, evaluate, words

    s = Session(spark)
    s.add_spec("X", SPEC)
    s.add_data_source("d", spark.createDataFrame([(1, bytearray(b""))], "k long, content binary"))
    b, node, slot = s.eval("d <> X.Words")._program().board()
    gc.collect()
    gc.disable()
    try:
        data = pa.array([b"a.b.a"], pa.binary())
        words(b.rt, slot, b.rt.choices(node.right)[0][0], data)
        evaluate(b.rt, slot, node, data, pa.struct([("word", pa.binary())]), True)
        held = [c for c in gc.get_objects() if isinstance(c, Column) and c.__dict__]
    finally:
        gc.enable()
    assert not held
