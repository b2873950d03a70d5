"""Catalyst and numpy strategies against the box-by-box decoder, on whole, cut and empty sources."""

import random

import pytest

import bytetree.session as S
from bytetree.session import Session

SPEC = """
let U = integer { @signed: false; @endian: 'big'; };  let L = integer { @signed: true; @endian: 'little'; };
let Pair = struct { a: [2] byte <> U; b: struct { c: [4] byte <> L; d: [3] byte; }; [1] byte; t: [5] byte <> string { @boundary: '.'; }; };
let Bare = struct { recs: [] Pair; };
let Padded = struct { recs: [] struct { k: byte <> U; @span: 4; }; };
let Counted = struct { m: byte; n: byte <> L; recs: [n] Two; rest: [] byte; };  let Two = [2] byte <> U;
let Framed = struct { head: [3] byte; recs: [] Pair; tail: [2] byte; };
let Ints = struct { v: [] varint; };
let Kinds = struct {
    kind: byte <> U; n: byte <> U;
    if (kind == 0) { user: [4] byte <> U; } else if (kind == 1 && n > 2) { user: [2] byte <> U; extra: [2] byte <> L; } else { name: [4] byte <> string { @boundary: '.'; }; [1] byte; }
    struct { in: byte <> U; deep: struct { a: byte; b: [2] byte <> L; }; };
    tail: byte <> U;
};
let Chained = struct { a: byte <> U; if (a > 1) { b: byte <> U; } if (b > 1) { c: byte <> U; } };
"""


def blobs(n=60):
    r = random.Random(4)
    out = [b"", b"\x00", b"\x80", b"\x01\x02", b"\x05\xff\x01\x02", b"\x00\x00", bytes(range(1, 46))]
    out += [bytes(r.choice((46, 0, 1, 2, 127, 128, 200, 255)) for _ in range(r.randrange(0, 70))) for _ in range(n)]
    return out + [bytes(r.randrange(128) for _ in range(k)) + b"\x01" for k in range(20)]


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    s.add_spec("X", SPEC)
    s.add_data_source("d", spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs())], "k long, content binary").repartition(2))
    return s


def plain(rows, cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=str)


def python_in(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan or "ArrowEval" in plan or "BatchEval" in plan


EXPRESSIONS = [
    ("(d <> X.Bare).recs", True), ("(d <> X.Padded).recs", True), ("(d <> X.Counted).recs", True), ("(d <> X.Framed).recs", True), ("d <> ([] X.Pair)", True), ("(d <> X.Bare).recs[1..]", True),
    ("(d <> X.Bare).recs[..2]", True), ("(d <> X.Bare).recs[..-1]", True), ("(d <> X.Bare).recs[..-1][1..]", True), ("(d <> X.Bare).recs[-2..]", True), ("(d <> X.Bare).recs[1..2]", False), ("(d <> X.Ints).v", False),
]


@pytest.mark.parametrize("mode", ["PERMISSIVE", "DROPMALFORMED"])
@pytest.mark.parametrize("expr,builtin", EXPRESSIONS)
def test_rows_are_those_of_the_decoder(session, monkeypatch, expr, builtin, mode):
    auto, numpy = session.eval(expr, mode=mode), session.eval(expr, "decoder", mode)
    got = auto.rows()
    assert python_in(got) != builtin
    cols = ["k", "ordinal", "item", *(["status"] if "status" in got.columns else [])]
    fast, by_numpy = plain(got.collect(), cols), plain(numpy.rows().collect(), cols)
    with monkeypatch.context() as m:
        m.setattr(S.Items, "_vectors", lambda self: None)
        want = numpy.rows().collect()
    if "status" not in cols and expr != "(d <> X.Framed).recs":
        assert all(r.status is None for r in want)
    want = plain([r for r in want if "status" in cols or r.status is None], cols)
    assert by_numpy == want or "status" not in cols and [r for r in by_numpy if r[1] is not None] == want
    assert fast == want


@pytest.mark.parametrize("expr", ["d <> X.Bare", "(d <> X.Bare).recs", "d <> X.Padded"])
def test_nodes_are_those_of_the_decoder(session, expr):
    got = session.eval(expr).nodes()
    assert not python_in(got) and python_in(session.eval(expr).nodes(1))
    cols = [c for c in got.columns if c != "message"]
    assert plain(got.collect(), cols) == plain(session.eval(expr, "decoder").nodes().collect(), cols)


@pytest.mark.parametrize("name,builtin", [("Kinds", True), ("Chained", False)])
def test_conditional_structures_are_those_of_the_decoder(session, name, builtin):
    got = session.eval(f"d <> X.{name}").df()
    assert python_in(got) != builtin
    want = session.eval(f"d <> X.{name}", "decoder").df()
    assert got.schema.simpleString() == want.schema.simpleString()
    assert plain(got.collect(), ["k", "value", "status"]) == plain(want.collect(), ["k", "value", "status"])


def test_items_don_t_carry_their_source(spark):
    """65,536 items of a source of 4 MB: with the source beside each they were 256 GB."""
    s = Session(spark)
    s.add_spec("X", SPEC)
    s.add_data_source("d", spark.range(1).selectExpr("id k", "cast(repeat('0123456789abcdef', 262144) as binary) content"))
    rows = s.eval("d <> ([] struct { a: [8] byte; b: [56] byte; })", "decoder").rows()
    assert rows.selectExpr("count(*)", "max(ordinal)", "min(item.a) = max(item.a)").first() == (65536, 65535, True)
