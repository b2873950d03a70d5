import duckdb
import pytest
from pyspark.sql import functions as F

from bytetree.errors import ExprError
from bytetree.functions import encode as E
from bytetree.operators import nodes as N
from bytetree.queries import BASE, ORACLES, QUERIES
from bytetree.session import Session
from bytetree.sources import buffers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def cells(rows):
    return sorted((tuple(x if x is None or isinstance(x, (str, bool)) else int(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(ORACLES[name]).select(*(f'"{c}"' for c in cols)).fetchall()
    assert cells(map(tuple, got.select(*cols).collect())) == cells(want)


def test_file_filter_reads_all_of_its_lookup_table(spark, tmp_path):
    spark.createDataFrame([(3, "R3"), (17, "R17")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert sorted(map(tuple, QUERIES["file_filter"](spark, str(tmp_path)).collect())) == [(3, "N3"), (17, "N17")]


RECORDS = "let Rec = struct { k: u64; c: s32; l: u16l; t: [5] byte <> NulText; in: struct { a: u8; raw: [2] byte; }; };"


@pytest.mark.parametrize("spec,expr", [("let Schema = struct { recs: [] Rec; };", "(data <> Spec.Schema).recs"), ("let Schema = struct { head: u16; recs: [] Rec; tail: [3] byte; };", "(data <> Spec.Schema).recs"), ("let Schema = [2] Rec;", "data <> Spec.Schema")])
def test_strategies_agree(spark, spec, expr):
    df = spark.range(3).selectExpr("id as k", "unhex(repeat('00FF10A3', cast(12 + 9 * id as int))) as content")
    s = Session(spark)
    s.add_spec("Spec", BASE + RECORDS + spec)
    s.add_data_source("data", df)
    fast, slow = (s.eval(expr, how).rows().select("k", "ordinal", "item.*") for how in ("catalyst", "decoder"))
    assert fast.schema.simpleString() == slow.schema.simpleString()
    key = lambda r: (r.k, r.ordinal)
    assert sorted(fast.collect(), key=key) == sorted(slow.collect(), key=key)
    plan = s.eval(expr, "catalyst").rows()._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("boundary,data", [("\\n", [b"a\nb\n\nc", b"", b"\n", b"x\n", b"\n\ny"]), ("ab", [b"1ab2aab", b"ab", b"a", b"\xff\x00ab\xe9"]), (".", [b"a.b", b"..", b"\\E.\\Q"])])
def test_delimited_items_agree(spark, boundary, data):
    s = Session(spark)
    s.add_spec("Spec", f"let Bare = [] string {{ @boundary: '{boundary}'; }};  let Boxed = [] struct {{ w: string {{ @boundary: '{boundary}'; }}; @key: w; }};")
    s.add_data_source("data", buffers(spark, {str(i): d for i, d in enumerate(data)}))
    for t in ("Bare", "Boxed"):
        fast, slow = (s.eval(f"data <> Spec.{t}", how).rows().select("name", "ordinal", "item") for how in ("auto", "decoder"))
        assert "MapInArrow" not in fast._jdf.queryExecution().toString()
        assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))


def test_modes_and_statuses(spark):
    s = Session(spark)
    s.add_spec("Spec", BASE + "let Schema = struct { n: u8; t: [n] byte <> formatted_integer; };")
    s.add_data_source("data", buffers(spark, {"good": b"\x0212", "long": b"\x0912", "bad": b"\x02xy", "none": b""}))
    got = {r.name: (r.value, r.status) for r in s.eval("(data <> Spec.Schema).t").df().collect()}
    assert got == {"good": (12, None), "long": (None, "out_of_bounds"), "bad": (None, "data_error"), "none": (None, "out_of_bounds")}
    assert s.eval("(data <> Spec.Schema).t", mode="DROPMALFORMED").df().count() == 1
    with pytest.raises(Exception, match="12|bytes|digit|left"):
        s.eval("(data <> Spec.Schema).t", mode="FAILFAST").df().collect()
    whole = {r.name: r.value for r in s.eval("data <> Spec.Schema").df().collect()}
    assert whole["bad"].n == 2 and whole["bad"].t is None  # a bad member spoils no other
    with pytest.raises(ExprError):
        s.eval("(data <> Spec.Schema).n +")
    with pytest.raises(ExprError):
        s.eval("data <> Spec.Schema", strategy="catalyst").rows()


def test_node_table_and_cursor(spark):
    s = Session(spark)
    s.add_spec("Spec", BASE + "let Schema = [] struct { name: NulText; v: u8; @key: name; };")
    s.add_data_source("data", buffers(spark, {"x": b"a\0\1b\0\2a\0\3"}).withColumnRenamed("name", "source"))
    n = s.eval("data <> Spec.Schema").nodes().cache()
    a = N.by_key(n, b"a", 1)
    assert [(r.ordinal, r.dpath, r.offset) for r in a.collect()] == [(2, '["a"{1}]', 6)]
    assert [r.v_int for r in N.named(N.children(n, a, ["source"]), "v").collect()] == [3] and N.parents(n, a, ["source"]).count() == 1
    assert N.by_key(n, b"a", None).count() == 2 and N.nth(n.filter("depth = 1"), 1).first().key_bin == b"b"
    assert N.format_key(b"a", 1) == '"a"{1}' and N.format_key(3) == "3"
    assert N.reverse(n).first().node_id == n.count() - 1 and N.at_path(n, '["b"].v').first().v_int == 2


def test_node_table_has_every_level(spark):
    s = Session(spark)
    s.add_spec("Spec", BASE + "let Box = struct { size: u8; kind: u8; @span: size; if (kind == 1) { x: [] Box; } else { x: u8; } };  let Schema = [] Box;")
    levels = 100
    data = b"\3\0\7"
    for _ in range(levels - 1):
        data = bytes([len(data) + 2, 1]) + data
    s.add_data_source("data", buffers(spark, {"x": data}).withColumnRenamed("name", "source"))
    n = s.eval("data <> Spec.Schema").nodes().cache()
    assert n.filter("status is not null").count() == 0 and n.filter("name = 'kind'").count() == levels
    assert n.filter("v_int = 7 and name = 'x'").first().depth == n.agg(F.max("depth")).first()[0] > 64
    assert s.eval("data <> Spec.Schema").nodes(2).agg(F.max("depth")).first()[0] == 2


def test_recursive_and_mixed_types_are_json(spark):
    s = Session(spark)
    s.add_spec("Spec", BASE + "let Box = struct { size: u8; kind: u8; @span: size; if (kind == 1) { x: [] Box; } else { x: u8; } };  let Schema = [] Box;")
    s.add_data_source("data", buffers(spark, {"x": bytes([8, 1, 3, 0, 7, 3, 0, 9])}))
    assert s.eval("(data <> Spec.Schema)[0]").df().first().value.x == '[{"size": 3, "kind": 0, "x": 7}, {"size": 3, "kind": 0, "x": 9}]'
    assert s.eval("data <> Spec.Schema").python()[0][0]["x"][1]["x"] == 9 and "kind: 1" in s.eval("data <> Spec.Schema").yaml()


def test_empty_input_and_constants(spark):
    s = Session(spark)
    s.add_spec("Spec", BASE + "let Schema = [] u16;")
    s.add_data_source("data", spark.createDataFrame([], "name string, content binary"))
    assert s.eval("data <> Spec.Schema").rows().count() == 0 and s.eval("data <> Spec.Schema").nodes().count() == 0
    s.add_data_source("small", b"\0\5")
    assert s.eval("(small <> Spec.Schema)[0] + 1").df().first().value == 6


def test_scalar_columns_wrap(spark):
    s = Session(spark)
    big = (F.lit(2**63 - 1), "int")
    row = spark.range(1).select(s.column("a + 1", a=big).alias("p"), s.column("a * a", a=big).alias("m"), s.column("a / (1 - 1)", a=big).alias("z"), s.column("-7 / 2").alias("d"), s.column("1 << 65").alias("s"), s.column("-(-a - 1)", a=big).alias("n")).first()
    assert tuple(row) == (-(2**63), 1, None, -3, 2, -(2**63))


def test_stream_of_files(spark, tmp_path):
    from bytetree.streaming import stream_rows

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.bin").write_bytes(bytes([i, i + 1]))
    s = Session(spark)
    s.add_spec("Spec", BASE + "let Schema = [] u8;")
    rows = stream_rows(s, "data <> Spec.Schema", "data", str(tmp_path / "in"))
    q = rows.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.item for r in spark.table("arrived").collect()) == [0, 1, 1, 2, 2, 3]


def test_encoders(spark):
    row = spark.range(1).select(E.u_be(F.lit(258), 4), E.u_le(F.lit(-2), 2), E.varint(F.lit(300)), E.varint(F.lit(0)), E.padded(F.lit("ab"), 4)).first()
    assert tuple(row) == ("00000102", "FEFF", "AC02", "00", "61620000")


def test_command_line(tmp_path, capsys):
    from bytetree.__main__ import main

    p = tmp_path / "w.words"
    p.write_bytes(b"one\ntwo\n")
    assert main(["dump", str(p)]) == 0 and '"two"' in capsys.readouterr().out
    main(["xdump", str(p)])
    assert "6f 6e 65" in capsys.readouterr().out
