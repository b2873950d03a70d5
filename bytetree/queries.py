"""One query for each operator of the language: a table is packed into bytes, read back through a schema, and compared with
plain SQL over the table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import encode as E
from .operators.index import by_index, nearest_mark, write_key_index, write_offset_index
from .operators.nodes import at_path, by_key, children, enter_slice, goto_end, iterate, named, next_item, next_with_key, parents, positions, reverse, twins
from .formats import find_format, schema_of
from .session import Session
from .sources import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = """
let Big = integer { @signed: false; @endian: 'big'; };
let Little = integer { @signed: false; @endian: 'little'; };
let u8 = byte <> Big;  let u16 = [2] byte <> Big;  let u32 = [4] byte <> Big;  let u64 = [8] byte <> Big;
let u16l = [2] byte <> Little;  let u32l = [4] byte <> Little;
let s32 = [4] byte <> integer { @signed: true; @endian: 'big'; };
let NulText = string { @boundary: '\\0'; };
let Line = string { @boundary: '\\n'; };
"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _over(spark: SparkSession, df: DataFrame, spec: str, column: str = "content") -> Session:
    s = Session(spark)
    s.add_spec("Spec", BASE + spec)
    s.add_data_source("data", df, column)
    return s


def _text(c) -> F.Column:
    return F.decode(c, "UTF-8")


# ---------------------------------------------------------------- scalar operators
def _scalars(table: str, keys: list[str], names: dict[str, tuple[str, str]], exprs: dict[str, str]):
    def run(spark, d):
        s, env = Session(spark), {k: (F.expr(e), kind) for k, (e, kind) in names.items()}
        return _table(spark, d, table).select(*keys, *(s.column(x, **env).alias(k) for k, x in exprs.items()))

    return run


_LINE = {"a": ("l_orderkey", "int"), "b": ("l_partkey", "int"), "c": ("l_linenumber", "int"), "n": ("l_suppkey - 50", "int")}
_KEYS = ["l_orderkey", "l_linenumber"]


def _sql(table: str, keys: list[str], cols: dict[str, str]) -> str:
    return f"SELECT {', '.join(keys)}, {', '.join(f'{e} AS {k}' for k, e in cols.items())} FROM {table}"


for _name, _exprs, _cols in (
    ("int_arith", {"x_add": "a + b", "x_sub": "n - b", "x_mul": "a * n", "x_div": "n / c", "x_mod": "n % c", "x_neg": "-n", "x_pos": "+n", "x_mix": "1 + a * 2 - b / c % 3"}, {"x_add": "l_orderkey + l_partkey", "x_sub": "l_suppkey - 50 - l_partkey", "x_mul": "l_orderkey * (l_suppkey - 50)", "x_div": "(l_suppkey - 50) // l_linenumber", "x_mod": "(l_suppkey - 50) % l_linenumber", "x_neg": "-(l_suppkey - 50)", "x_pos": "l_suppkey - 50", "x_mix": "1 + l_orderkey * 2 - (l_partkey // l_linenumber) % 3"}),
    ("int_bitwise", {"x_or": "a | b", "x_and": "a & n", "x_xor": "a ^ n", "x_not": "~n"}, {"x_or": "l_orderkey | l_partkey", "x_and": "l_orderkey & (l_suppkey - 50)", "x_xor": "xor(l_orderkey, l_suppkey - 50)", "x_not": "-1 - (l_suppkey - 50)"}),
    ("int_shift", {"x_left": "a << c", "x_right": "a >> c", "x_signed": "n >> 1"}, {"x_left": "l_orderkey * (CAST(1 AS BIGINT) << CAST(l_linenumber AS BIGINT))", "x_right": "l_orderkey // (CAST(1 AS BIGINT) << CAST(l_linenumber AS BIGINT))", "x_signed": "CAST(floor((l_suppkey - 50) / 2.0) AS BIGINT)"}),
    ("int_compare", {"x_eq": "c == 2", "x_ne": "c != 2", "x_lt": "a < b", "x_le": "a <= b", "x_gt": "a > b", "x_ge": "a >= b"}, {"x_eq": "l_linenumber = 2", "x_ne": "l_linenumber <> 2", "x_lt": "l_orderkey < l_partkey", "x_le": "l_orderkey <= l_partkey", "x_gt": "l_orderkey > l_partkey", "x_ge": "l_orderkey >= l_partkey"}),
    ("bool_logic", {"x_and": "a < b && c == 1", "x_or": "a < b || c == 1", "x_not": "!(a < b)", "x_same": "(a < b) == (c == 1)", "x_differ": "(a < b) != (c == 1)", "x_lit": "true != (c == 1)"}, {"x_and": "l_orderkey < l_partkey AND l_linenumber = 1", "x_or": "l_orderkey < l_partkey OR l_linenumber = 1", "x_not": "NOT (l_orderkey < l_partkey)", "x_same": "(l_orderkey < l_partkey) = (l_linenumber = 1)", "x_differ": "(l_orderkey < l_partkey) <> (l_linenumber = 1)", "x_lit": "true <> (l_linenumber = 1)"}),
):
    query(_name, _sql("lineitem", _KEYS, _cols))(_scalars("lineitem", _KEYS, _LINE, _exprs))
query("string_equality", _sql("orders", ["o_orderkey"], {"x_eq": "o_orderstatus = 'F'", "x_ne": "o_orderpriority <> '1-URGENT'", "x_same": "o_orderstatus = o_orderpriority"}))(
    _scalars("orders", ["o_orderkey"], {"s": ("o_orderstatus", "string"), "p": ("o_orderpriority", "string")}, {"x_eq": "s == 'F'", "x_ne": "p != '1-' \"URGENT\"", "x_same": "s == p"})
)


# ---------------------------------------------------------------- fixed layouts
_ORDERS = "let Rec = struct { k: u64; c: u32l; p: [16] byte <> NulText; d: s32; };  let Schema = struct { recs: [] Rec; };"


def _orders(spark, d) -> DataFrame:
    o = _table(spark, d, "orders")
    rec = F.concat(E.u_be(F.col("o_orderkey"), 8), E.u_le(F.col("o_custkey"), 4), E.padded(F.col("o_orderpriority"), 16), E.u_be(F.col("o_custkey") - F.col("o_orderkey"), 4))
    return E.blobs(o, F.expr("o_orderkey div 500"), ["o_orderkey"], rec)


def _decoded(field: str, strategy: str = "auto"):
    def run(spark, d):
        rows = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs", strategy).rows()
        value = F.col(f"item.{field}")
        return rows.select("k", "ordinal", (_text(value) if field == "p" else value).alias("value"))

    return run


def _decoded_sql(value: str) -> str:
    return f"SELECT o_orderkey // 500 AS k, row_number() OVER (PARTITION BY o_orderkey // 500 ORDER BY o_orderkey) - 1 AS ordinal, {value} AS value FROM orders"


query("decode_u64_be", _decoded_sql("o_orderkey"))(_decoded("k"))
query("decode_u32_le", _decoded_sql("o_custkey"))(_decoded("c"))
query("decode_signed", _decoded_sql("o_custkey - o_orderkey"))(_decoded("d"))
query("decode_by_decoder", _decoded_sql("o_custkey - o_orderkey"))(_decoded("d", "decoder"))
query("string_fixed_nul", _decoded_sql("o_orderpriority"))(_decoded("p"))


@query("decode_group", "SELECT o_orderpriority AS p, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY 1")
def decode_group(spark, d):
    rows = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs").rows()
    return rows.groupBy(_text(F.col("item.p")).alias("p")).agg(F.count("*").alias("n"), F.sum("item.k").alias("s"))


@query(
    "struct_layout_offsets",
    'SELECT o_orderkey // 500 AS k, i AS ordinal, CAST(32 * i + f.off AS BIGINT) AS "offset", CAST(f.size AS BIGINT) AS size, f.name '
    "FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 500 ORDER BY o_orderkey) - 1 AS i FROM orders), (VALUES "
    "('k', 0, 8), ('c', 8, 4), ('p', 12, 16), ('d', 28, 4)) f(name, off, size)",
)
def struct_layout_offsets(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs").nodes()
    recs = n.filter("depth = 1").select("k", F.col("node_id").alias("parent_id"), "ordinal")
    return n.filter("depth = 2").drop("ordinal").join(recs, ["k", "parent_id"]).select("k", "ordinal", "offset", "size", "name")


@query(
    "node_table_stats",
    "SELECT k, depth, CAST(n * m AS BIGINT) AS nodes, CAST(CASE WHEN depth = 2 THEN 4 ELSE NULL END AS BIGINT) AS members FROM (SELECT "
    "o_orderkey // 500 AS k, count(*) AS n FROM orders GROUP BY 1), (VALUES (2, 1), (3, 4)) f(depth, m)",
)
def node_table_stats(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("data <> Spec.Schema").nodes()
    return n.filter("depth >= 2").groupBy("k", "depth").agg(F.count("*").alias("nodes"), F.max(F.when(F.col("depth") == 2, F.col("n_items"))).alias("members"))


@query("cursor_children", "SELECT o_orderkey // 500 AS k, min(o_orderkey) AS key, min_by(o_custkey, o_orderkey) AS cust FROM orders GROUP BY 1")
def cursor_children(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs").nodes()
    first = n.filter("depth = 1 AND ordinal = 0")
    below = children(n, first, ["k"])
    pick = lambda f: named(below, f).select("k", F.col("v_int").alias({"k": "key", "c": "cust"}[f]))
    return pick("k").join(pick("c"), "k")


# ---------------------------------------------------------------- arrays
def _lines(spark, d) -> DataFrame:
    li = _table(spark, d, "lineitem")
    rec = F.concat(E.u_be(F.col("l_linenumber"), 1), E.u_be(F.col("l_partkey"), 4))
    return E.blobs(li, F.col("l_orderkey"), ["l_linenumber", "l_partkey", "l_suppkey"], rec)


_ITEMS = "let Item = struct { n: u8; p: u32; };  let Schema = struct { items: [] Item; };  let Until = struct { items: [] Last; rest: [] byte; };  let Last = struct { n: u8; p: u32; @last: n == 3; };  let Capped = struct { items: [5] Last; };"
_LISTS = "WITH t AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem GROUP BY 1) "


def _value(name: str, expr: str, sql: str):
    @query(name, sql)
    def run(spark, d):
        return _over(spark, _lines(spark, d), _ITEMS).eval(expr).df().select("k", "value", "status")


    return run


_value("array_subscript", "(data <> Spec.Schema).items[1].p", _LISTS + "SELECT k, p[2] AS value, CASE WHEN len(p) < 2 THEN 'no_item' END AS status FROM t")
_value("array_negative", "(data <> Spec.Schema).items[-1].p", _LISTS + "SELECT k, p[-1] AS value, CAST(NULL AS VARCHAR) AS status FROM t")
_value("array_len", "len((data <> Spec.Schema).items)", _LISTS + "SELECT k, len(p) AS value, CAST(NULL AS VARCHAR) AS status FROM t")
_value("array_size", "sizeof (data <> Spec.Schema).items + sizeof(Spec.Item)", _LISTS + "SELECT k, 5 * len(p) + 5 AS value, CAST(NULL AS VARCHAR) AS status FROM t")
_value(
    "array_index",
    "index((data <> Spec.Schema).items, (data <> Spec.Schema).items[-1])",
    _LISTS +
    "SELECT k, len(p) - 1 AS value, CAST(NULL AS VARCHAR) AS status FROM t",
)
_value("address_of", "&(data <> Spec.Schema).items[-1].p", _LISTS + "SELECT k, 5 * len(p) - 4 AS value, CAST(NULL AS VARCHAR) AS status FROM t")
_value(
    "last_inclusive",
    "len((data <> Spec.Until).items) * 100 + len((data <> Spec.Until).rest)",
    _LISTS +
    ", u AS (SELECT *, coalesce(list_position(n, 3), len(n)) AS m FROM t) SELECT k, 100 * m + 5 * (len(n) - m) AS value, CAST(NULL AS "
    "VARCHAR) AS status FROM u",
)


def _sliced(name: str, expr: str, sql: str):
    @query(name, _LISTS + sql)
    def run(spark, d):
        rows = _over(spark, _lines(spark, d), _ITEMS).eval(expr, mode="DROPMALFORMED").rows()
        return rows.select("k", "ordinal", F.col("item.p").alias("p"))

    return run


_sliced("array_slice", "(data <> Spec.Schema).items[1..]", "SELECT k, i AS ordinal, p[i + 2] AS p FROM (SELECT *, unnest(range(0, len(p) - 1)) AS i FROM t)")
_sliced("slice_of_slice", "(data <> Spec.Schema).items[..-1][1..]", "SELECT k, i AS ordinal, p[i + 2] AS p FROM (SELECT *, unnest(range(0, len(p) - 2)) AS i FROM t)")


@query("counted_array", "SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey AS item FROM orders")
def counted_array(spark, d):
    o = _table(spark, d, "orders")
    packed = E.blobs(o, F.col("o_custkey"), ["o_orderkey"], E.u_be(F.col("o_orderkey"), 8))
    framed = packed.select("k", F.concat(F.unhex(E.u_be(F.length("content") / 8, 2)), "content", F.unhex(F.lit("FFFF"))).alias("content"))
    return _over(spark, framed, "let Schema = struct { n: u16; keys: [n] u64; tail: [] byte; };").eval("(data <> Spec.Schema).keys").rows().select("k", "ordinal", "item")


@query(
    "varint_roundtrip",
    "SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ordinal, "
    "l_partkey * l_linenumber AS value FROM lineitem",
)
def varint_roundtrip(spark, d):
    li = _table(spark, d, "lineitem")
    packed = E.blobs(li, F.col("l_orderkey"), ["l_linenumber", "l_partkey", "l_suppkey"], E.varint(F.col("l_partkey") * F.col("l_linenumber")))
    return _over(spark, packed, "let Schema = [] varint;").eval("data <> Spec.Schema").rows().select("k", "ordinal", F.col("item").alias("value"))


@query(
    "slack_greedy_mix",
    "SELECT c_custkey AS k, c_custkey % 997 // 100 AS huge, c_custkey % 997 % 100 // 30 AS big, c_custkey % 997 % 100 % 30 // 10 AS "
    "small, c_custkey % 997 % 100 % 30 % 10 AS rest FROM customer",
)
def slack_greedy_mix(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("cast(repeat('x', cast(c_custkey % 997 as int)) as binary)").alias("content"))
    spec = "let A = struct { [100] byte; };  let B = struct { [30] byte; };  let C = struct { [10] byte; };  let Schema = struct { huge: [] A; big: [] B; small: [] C; rest: [] byte; let ?all = len(huge) * 1000 * 1000 + len(big) * 10000 + len(small) * 100 + len(rest); };"
    v = _over(spark, c, spec).eval("(data <> Spec.Schema).?all").df()
    part = lambda a, b: F.expr(f"cast(value div {a} % {b} as bigint)")
    return v.select("k", part(1000000, 1000).alias("huge"), part(10000, 100).alias("big"), part(100, 100).alias("small"), part(1, 100).alias("rest"))


# ---------------------------------------------------------------- texts
@query(
    "string_boundary_split",
    "SELECT doc_id, i - 1 AS ordinal, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, CASE WHEN l[-1] = '' THEN len(l) ELSE len(l) "
    "+ 1 END)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''))",
)
def string_boundary_split(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    return _over(spark, docs, "let Schema = [] Line;", "text").eval("data <> Spec.Schema").rows().select("doc_id", "ordinal", _text(F.col("item")).alias("line"))


@query("formatted_integer", "SELECT o_custkey AS k, CAST(sum(o_orderkey - 7000) AS BIGINT) AS total FROM orders GROUP BY 1")
def formatted_integer(spark, d):
    o = _table(spark, d, "orders")
    packed = E.blobs(o, F.col("o_custkey"), ["o_orderkey"], E.text(F.concat((F.col("o_orderkey") - 7000).cast("string"), F.lit("\n"))))
    rows = _over(spark, packed, "let Schema = [] Number;  let Number = Line <> formatted_integer { @base: 10; };").eval("data <> Spec.Schema").rows()
    return rows.groupBy("k").agg(F.sum("item").alias("total"))


@query("base64_decode", "SELECT doc_id, text AS value FROM documents")
def base64_decode(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b"))
    docs = docs.withColumn("b", F.translate("b", "\r\n", ""))
    return _over(spark, docs, "let Schema = base64;", "b").eval("data <> Spec.Schema").df().select("doc_id", _text(F.col("value")).alias("value"))


@query("filter_chain_ancestor", "SELECT doc_id, md5(text) AS x0, md5(to_base64(encode(text))) AS x1 FROM documents")
def filter_chain_ancestor(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "").alias("b"))
    s = _over(spark, docs, "let Text = struct { t: [] byte; };  let Schema = struct { e: string <> base64 <> Text; };", "b")
    one, two = (s.eval(f"{up}(data <> Spec.Schema).e").df().select("doc_id", F.md5("value").alias(f"x{k}")) for k, up in enumerate(("^", "^^^")))
    return one.join(two, "doc_id")


@query("deflate_decode", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, md5(text) AS digest FROM documents")
def deflate_decode(spark, d):
    @F.pandas_udf("binary")
    def deflated(t: pd.Series) -> pd.Series:
        import zlib

        z = lambda x: (c := zlib.compressobj(6, zlib.DEFLATED, -15)).compress(x.encode()) + c.flush()
        return t.map(z)

    docs = _table(spark, d, "documents").select("doc_id", F.concat(deflated("text"), F.unhex(E.u_be(F.octet_length("text"), 4))).alias("content"))
    spec = "let Schema = struct { body: deflate { @output_size: n; }; n: u32; };"
    v = _over(spark, docs, spec).eval("(data <> Spec.Schema).body").df()
    return v.select("doc_id", F.length("value").cast("long").alias("n"), F.md5("value").alias("digest"))


@query("snappy_decode", "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, md5(html) AS digest FROM pages")
def snappy_decode(spark, d):
    n = F.octet_length("html")
    pages = _table(spark, d, "pages").select("page_id", F.concat(F.unhex(F.concat(E.varint(n), F.lit("F8"), E.u_le(n - 1, 3))), F.encode("html", "UTF-8")).alias("content"))
    v = _over(spark, pages, "let Schema = snappy;").eval("data <> Spec.Schema").df()
    return v.select("page_id", F.length("value").cast("long").alias("n"), F.md5("value").alias("digest"))


@query("trailer_length_at_end", "SELECT doc_id, md5(text) AS text, md5(source) AS source FROM documents")
def trailer_length_at_end(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), F.encode("source", "UTF-8"), F.unhex(E.u_be(F.octet_length("source"), 1))).alias("content"))
    v = _over(spark, docs, "let Schema = struct { text: [] byte; source: [n] byte; n: u8; };").eval("data <> Spec.Schema").df()
    return v.select("doc_id", F.md5("value.text").alias("text"), F.md5("value.source").alias("source"))


_WORDS = "let Word = struct { word: string { @boundary: ' '; }; @key: word; };  let Schema = [] Word;"
_WORDLIST = "WITH w AS (SELECT doc_id, string_split(text, ' ') AS l FROM documents WHERE text <> ''), x AS (SELECT doc_id, i - 1 AS ordinal, l[i] AS word FROM (SELECT *, unnest(range(1, CASE WHEN l[-1] = '' THEN len(l) ELSE len(l) + 1 END)) AS i FROM w)) "


def _keyed(name: str, expr: str, sql: str):
    @query(name, _WORDLIST + sql)
    def run(spark, d):
        docs = _table(spark, d, "documents").select("doc_id", "text")
        s = _over(spark, docs, _WORDS, "text")
        return s.eval(expr, mode="DROPMALFORMED").df().filter("status is null").select("doc_id", "value")

    return run


_keyed(
    "keyed_lookup",
    "&(data <> Spec.Schema)['the']",
    "SELECT doc_id, CAST(octet_length(encode(array_to_string(list_slice(l, 1, list_position(l, 'the') - 1), ' '))) + CASE WHEN "
    "list_position(l, 'the') > 1 THEN 1 ELSE 0 END AS BIGINT) AS value FROM w WHERE list_contains(l, 'the')",
)
_keyed(
    "keyed_twin",
    "index(data <> Spec.Schema, (data <> Spec.Schema)['the'{2}])",
    "SELECT doc_id, ordinal AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS twin FROM x WHERE "
    "word = 'the') WHERE twin = 2",
)
_keyed(
    "keyed_slice",
    "index(data <> Spec.Schema, (data <> Spec.Schema)[3..]['the'{1}])",
    "SELECT doc_id, ordinal AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS twin FROM x WHERE "
    "word = 'the' AND ordinal >= 3) WHERE twin = 1",
)


@query(
    "keyed_all_twins",
    _WORDLIST +
    "SELECT doc_id, ordinal, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS INT) AS twin FROM x WHERE word = "
    "'and'",
)
def keyed_all_twins(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    n = _over(spark, docs, _WORDS, "text").eval("data <> Spec.Schema").nodes(1)
    return by_key(n.filter("depth = 1"), b"and", None).select("doc_id", "ordinal", "twin")


@query(
    "twins_by_window",
    _WORDLIST +
    "SELECT doc_id, max(twin) AS most FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, word ORDER BY ordinal) - 1 AS twin "
    "FROM x) GROUP BY 1",
)
def twins_by_window(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    rows = _over(spark, docs, _WORDS, "text").eval("data <> Spec.Schema").rows().select("doc_id", "ordinal", F.col("item.word").alias("word"))
    return twins(rows, ["doc_id"], "word").groupBy("doc_id").agg(F.max("twin").cast("long").alias("most"))


# ---------------------------------------------------------------- structures
@query("union_overlay", "SELECT o_orderkey AS k, o_orderkey AS whole, o_orderkey // 65536 AS hi, CAST(4 AS BIGINT) AS size FROM orders")
def union_overlay(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.unhex(E.u_be(F.col("o_orderkey"), 4)).alias("content"))
    s = _over(spark, o, "let Schema = struct { u: union { whole: u32; hi: u16; }; let ?size = sizeof u; };")
    return s.eval("(data <> Spec.Schema).u").df().select("k", "value.*").join(s.eval("(data <> Spec.Schema).?size").df().select("k", F.col("value").alias("size")), "k")


_EVENTS = """let Schema = struct {
    kind: u8;
    if (kind == 1) { user: u32; } else if (kind == 2) { user: u16; extra: u16; } else { name: [4] byte <> string; }
    if (kind == 1) { let ?who = user; } else { let ?who = kind * 1000; }
    tail: u8;
};"""


def _events(spark, d) -> DataFrame:
    u = F.col("user_id")
    kind = F.expr("cast(event_id % 3 + 1 as bigint)")
    body = F.when(kind == 1, E.u_be(u, 4)).when(kind == 2, F.concat(E.u_be(u, 2), E.u_be(u + 1, 2))).otherwise(E.padded(F.substring("event_type", 1, 4), 4))
    return _table(spark, d, "events").select("event_id", F.unhex(F.concat(E.u_be(kind, 1), body, E.u_be(kind + 5, 1))).alias("content"))


@query(
    "conditional_fields",
    'SELECT event_id, event_id % 3 + 1 AS kind, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id % 65536 END AS "user", CASE '
    "event_id % 3 WHEN 1 THEN (user_id + 1) % 65536 END AS extra, CASE event_id % 3 WHEN 2 THEN substr(event_type, 1, 4) END AS name, "
    "event_id % 3 + 6 AS tail FROM events",
)
def conditional_fields(spark, d):
    v = _over(spark, _events(spark, d), _EVENTS).eval("data <> Spec.Schema").df()
    return v.select("event_id", "value.kind", "value.user", "value.extra", _text(F.col("value.name")).alias("name"), "value.tail")


@query("named_expr_poly", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id ELSE (event_id % 3 + 1) * 1000 END AS value FROM events")
def named_expr_poly(spark, d):
    return _over(spark, _events(spark, d), _EVENTS).eval("(data <> Spec.Schema).?who").df().select("event_id", "value")


def _spans(name: str, spec: str, sql: str):
    @query(name, sql)
    def run(spark, d):
        c = _table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.unhex(F.concat(E.u_be(F.col("c_custkey") % 5, 1), F.repeat(F.lit("AB"), 19))).alias("content"))
        return _over(spark, c, spec).eval("(data <> Spec.Schema).?out").df().select("k", "value")

    return run


_spans(
    "span_padding",
    "let Schema = struct { a: struct { n: u8; x: [n] byte; @span: 8; }; b: [] byte; let ?out = sizeof a * 100 + len(b); };",
    "SELECT c_custkey AS k, CAST(812 AS BIGINT) AS value FROM customer",
)
_spans(
    "minspan_stop",
    "let Schema = struct { a: [] struct { x: [3] byte; @minspan: 7; }; rest: [] byte; let ?out = len(a) * 100 + len(rest); };",
    "SELECT c_custkey AS k, CAST(206 AS BIGINT) AS value FROM customer",
)
_spans(
    "maxspan_cap",
    "let Schema = struct { a: struct { n: u8; x: [] byte; @maxspan: 4 + n; }; rest: [] byte; let ?out = sizeof a * 100 + len(rest); };",
    "SELECT c_custkey AS k, (4 + c_custkey % 5) * 100 + 16 - c_custkey % 5 AS value FROM customer",
)


@query("anonymous_and_hidden", "SELECT c_custkey AS k, c_custkey AS a, c_nationkey AS b, c_custkey * 2 AS c, CAST(4 AS BIGINT) AS n FROM customer")
def anonymous_and_hidden(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = _table(spark, d, "customer").select(k.alias("k"), F.unhex(F.concat(E.u_be(k, 4), F.lit("FFFF"), E.u_be(n, 1), E.u_be(k * 2, 4), F.lit("00"))).alias("content"))
    s = _over(spark, c, "let Schema = struct { a: u32; [2] byte; struct { b: u8; Inner; }; pad: byte; };  let Inner = struct { c: u32; };")
    v = s.eval("data <> Spec.Schema").df().select("k", "value.a", F.col("value.b").cast("int").alias("b"), "value.c")
    return v.join(s.eval("len(data <> Spec.Schema)").df().select("k", F.col("value").alias("n")), "k")


@query("scope_closure", _LISTS + "SELECT k, k * 10 + n[1] AS \"first\", k * 10 + n[-1] AS \"last\" FROM t")
def scope_closure(spark, d):
    packed = _lines(spark, d).select("k", F.concat(F.unhex(E.u_be(F.col("k"), 8)), "content").alias("content"))
    spec = "let Order = struct { key: u64; lines: [] Line_;  let Line_ = struct { n: u8; key: u32; let ?id = Order::key * 10 + n; };  let ?first = lines[0].?id; };  let Schema = Order;"
    s = _over(spark, packed, spec)
    first, last = (s.eval(e).df().select("k", F.col("value").alias(n)) for n, e in (("first", "(data <> Spec.Schema).?first"), ("last", "(data <> Spec.Schema).lines[-1].?id")))
    return first.join(last, "k")


@query("pointer_chase", "SELECT c_custkey AS k, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def pointer_chase(spark, d):
    nations = E.blobs(_table(spark, d, "nation"), F.lit(1), ["n_nationkey"], E.padded(F.col("n_name"), 24)).select(F.col("content").alias("names"))
    nations = nations.select("names", F.explode(F.sequence(F.lit(0), F.expr("length(names) div 24 - 1"))).alias("at"))
    c = _table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("at")).select(F.col("c_custkey").alias("k"), F.concat(F.unhex(E.u_be(F.col("c_nationkey"), 1)), "names").alias("content"))
    spec = "let Schema = struct { at: u8; names: [] byte; let ?name = names[at * 24 .. at * 24 + 24] <> NulText; };"
    return _over(spark, c, spec).eval("(data <> Spec.Schema).?name").df().select("k", _text(F.col("value")).alias("name"))


@query("keyed_join", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def keyed_join(spark, d):
    rec = F.concat(E.u_be(F.col("c_custkey"), 4), E.padded(F.col("c_name"), 32))
    c = E.blobs(_table(spark, d, "customer"), F.expr("c_custkey div 1000"), ["c_custkey"], rec)
    rows = _over(spark, c, "let Rec = struct { id: u32; name: [32] byte <> NulText; @key: id; };  let Schema = struct { recs: [] Rec; };").eval("(data <> Spec.Schema).recs").rows()
    names = rows.select(F.col("item.id").alias("o_custkey"), _text(F.col("item.name")).alias("name"))
    return _table(spark, d, "orders").join(names, "o_custkey").select(F.col("o_orderkey").alias("k"), "name")


@query("recursive_boxes", "SELECT n_regionkey AS k, CAST(count(*) AS BIGINT) AS leaves, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1")
def recursive_boxes(spark, d):
    leaf = F.concat(E.u_be(F.lit(6), 4), F.lit("00"), E.u_be(F.col("n_nationkey"), 1))
    inner = E.blobs(_table(spark, d, "nation"), F.col("n_regionkey"), ["n_nationkey"], leaf)
    boxed = inner.select("k", F.concat(F.unhex(F.concat(E.u_be(F.length("content") + 5, 4), F.lit("01"))), "content").alias("content"))
    spec = "let Box = struct { size: u32; kind: u8; @span: size; if (kind == 1) { boxes: [] Box; } else { value: u8; } };  let Schema = struct { boxes: [] Box; };"
    n = _over(spark, boxed, spec).eval("data <> Spec.Schema").nodes()
    return named(n, "value").groupBy("k").agg(F.count("*").alias("leaves"), F.sum("v_int").alias("total"))


# ---------------------------------------------------------------- externals, dumps, errors
def _answer() -> int:
    return 42


class Shout:
    """A filter that replaces a word."""

    def read(self, data: memoryview) -> bytes:
        return bytes(data).replace(b"the", b"THE")


@query("udf_function", "SELECT n_nationkey AS k, CAST(n_nationkey + 42 AS BIGINT) AS value FROM nation")
def udf_function(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.unhex(E.u_be(F.col("n_nationkey"), 1)).alias("content"))
    s = Session(spark)
    s.register_function("answer", _answer)
    s.add_spec("Spec", BASE + "let Schema = struct { x: u8; };")
    s.add_data_source("data", n)
    return s.eval("(data <> Spec.Schema).x + answer").df().select("k", "value")


@query("udf_filter", "SELECT doc_id, md5(replace(text, 'the', 'THE')) AS value FROM documents")
def udf_filter(spark, d):
    s = Session(spark)
    s.register_filter("shout", Shout)
    s.add_data_source("data", _table(spark, d, "documents").select("doc_id", "text"), "text")
    return s.eval("data <> shout").raw().select("doc_id", F.md5("raw").alias("value"))


@query(
    "error_status",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'data_error' WHEN 1 THEN 'no_item' WHEN 2 THEN 'out_of_bounds' END AS status, CASE "
    "event_id % 4 WHEN 3 THEN user_id END AS value FROM events",
)
def error_status(spark, d):
    k = F.expr("event_id % 4")
    body = F.when(k == 0, F.lit("0178")).when(k == 1, F.lit("00")).when(k == 2, F.lit("FF31")).otherwise(F.concat(F.hex(F.char(F.length(F.col("user_id").cast("string")).cast("long"))), E.text(F.col("user_id").cast("string"))))
    e = _table(spark, d, "events").select("event_id", F.unhex(body).alias("content"))
    s = _over(spark, e, "let Schema = struct { n: u8; if (n > 0) { t: [n] byte <> formatted_integer; } };")
    return s.eval("(data <> Spec.Schema).t").df().select("event_id", "status", "value")


@query("dump_json", "SELECT r_regionkey AS k, '{\"id\": ' || r_regionkey || ', \"name\": \"' || r_name || '\"}' AS json FROM region")
def dump_json(spark, d):
    r = _table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.unhex(F.concat(E.u_be(F.col("r_regionkey"), 1), E.text(F.col("r_name")))).alias("content"))
    return _over(spark, r, "let Schema = struct { id: u8; name: string; };").eval("data <> Spec.Schema").json().select("k", "json")


@query(
    "hex_dump",
    'SELECT r_regionkey AS k, CAST(16 * i AS BIGINT) AS "offset", trim(regexp_replace(hex(encode(substr(r_name, CAST(16 * i + 1 AS '
    "BIGINT), 16))), '(..)', '\\1 ', 'g')) AS hex, substr(r_name, CAST(16 * i + 1 AS BIGINT), 16) AS text FROM (SELECT *, "
    "unnest(range(0, (length(r_name) + 15) // 16)) AS i FROM region)",
)
def hex_dump(spark, d):
    r = _table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.encode("r_name", "UTF-8").alias("content"))
    return _over(spark, r, "let Schema = bytes;").eval("data <> Spec.Schema").hexdump().select("k", "offset", "hex", "text")


@query("file_filter", "SELECT r_regionkey AS k, n_name AS value FROM region JOIN nation ON n_nationkey = r_regionkey")
def file_filter(spark, d):
    s = Session(spark)
    for n in _table(spark, d, "nation").collect():  # a lookup table that doesn't grow
        s.add_file(f"n{n.n_nationkey}", n.n_name.encode())
    s.add_spec("Spec", BASE + "let Schema = struct { path: string; let ?content = file { @path: path; }; };")
    s.add_data_source("data", _table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("n"), F.col("r_regionkey").cast("string")).alias("p")), "p")
    return s.eval("(data <> Spec.Schema).?content").raw().select("k", _text(F.col("raw")).alias("value"))


# ---------------------------------------------------------------- cursor moves
_LAST = "WITH t AS (SELECT o_orderkey // 500 AS k, list(o_orderkey ORDER BY o_orderkey) AS o FROM orders GROUP BY 1) "


@query("cursor_next", _LAST + "SELECT k, o[2] AS key FROM t WHERE len(o) > 1")
def cursor_next(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs").nodes()
    second = next_item(n, n.filter("depth = 1 AND ordinal = 0"), ["k"])
    return named(children(n, second, ["k"]), "k").select("k", F.col("v_int").alias("key"))


@query("cursor_return", _LAST + "SELECT k, CAST(len(o) - 1 AS BIGINT) AS ordinal, CAST(32 * (len(o) - 1) AS BIGINT) AS \"offset\" FROM t")
def cursor_return(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs").nodes()
    biggest = n.filter("depth = 2 AND name = 'k'").groupBy("k").agg(F.max_by("node_id", "v_int").alias("node_id"))
    last = n.join(biggest, ["k", "node_id"], "left_semi")
    return parents(n, last, ["k"]).select("k", "ordinal", "offset")


@query("cursor_end", _LAST + "SELECT k, CAST(len(o) AS BIGINT) AS ordinal, CAST(32 * len(o) AS BIGINT) AS \"offset\" FROM t")
def cursor_end(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs").nodes()
    return goto_end(n.filter("depth = 0"), ["k"]).select("k", "ordinal", "offset")


@query(
    "cursor_position",
    'WITH t AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT k, CAST(15 AS BIGINT) AS "offset", n = 3 AS '
    "at_end FROM t WHERE n >= 3",
)
def cursor_position(spark, d):
    n = _over(spark, _lines(spark, d), _ITEMS).eval("(data <> Spec.Schema).items").nodes()
    return positions(n, n.filter("depth = 0"), 3, ["k"]).select("k", "offset", "at_end")


@query("cursor_slice", _LISTS + "SELECT k, CAST(i - 2 AS BIGINT) AS ordinal, p[i] AS p FROM (SELECT *, unnest(range(2, len(p))) AS i FROM t)")
def cursor_slice(spark, d):
    n = _over(spark, _lines(spark, d), _ITEMS).eval("(data <> Spec.Schema).items").nodes()
    inner = enter_slice(n, n.filter("depth = 0"), 1, -1, ["k"])
    below = named(children(n, inner, ["k"]), "p").select("k", "parent_id", F.col("v_int").alias("p"))
    return inner.select("k", F.col("node_id").alias("parent_id"), "ordinal").join(below, ["k", "parent_id"]).select("k", "ordinal", "p")


@query(
    "cursor_items",
    "SELECT o_orderkey // 500 AS k, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS cust, min(o_orderpriority) AS low "
    "FROM orders GROUP BY 1",
)
def cursor_items(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs").nodes()
    each = iterate(n, n.filter("depth = 1"), ["k"], "items")
    return each.groupBy("k").agg(F.count_if(F.col("key") == "k").alias("n"), F.sum(F.when(F.col("key") == "c", F.col("value").cast("long"))).alias("cust"), F.min(F.when(F.col("key") == "p", F.col("value"))).alias("low"))


@query(
    "next_with_key",
    _WORDLIST +
    "SELECT doc_id, ordinal FROM (SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS twin FROM x "
    "WHERE word = 'the') WHERE twin = 1",
)
def next_with_key_(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    n = by_key(_over(spark, docs, _WORDS, "text").eval("data <> Spec.Schema").nodes(1), b"the", None)
    return next_with_key(n, by_key(n, b"the"), ["doc_id"]).select("doc_id", "ordinal")


@query("key_index", _WORDLIST + "SELECT doc_id, ordinal, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS INT) AS twin FROM x WHERE word = 'of'")
def key_index(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    path = work_folder(spark, "key-index")
    write_key_index(_over(spark, docs, _WORDS, "text").eval("data <> Spec.Schema").nodes(1), path, ["doc_id"])
    return by_index(spark, path, b"of", None).select("doc_id", "ordinal", "twin")


@query(
    "offset_index",
    "WITH w AS (SELECT doc_id, string_split(text, ' ') AS l FROM documents WHERE text <> ''), x AS (SELECT doc_id, l, len(l) - CASE "
    "WHEN l[-1] = '' THEN 1 ELSE 0 END AS n FROM w) SELECT doc_id, CAST(octet_length(encode(array_to_string(list_slice(l, 1, 64), ' "
    "'))) + 1 AS BIGINT) AS \"offset\", 6 AS ahead FROM x WHERE n > 64",
)
def offset_index(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    path = work_folder(spark, "offset-index")
    write_offset_index(_over(spark, docs, _WORDS, "text").eval("data <> Spec.Schema").nodes(1), path, ["doc_id"])
    return nearest_mark(spark, path, 70).select("doc_id", "offset", "ahead")


# ---------------------------------------------------------------- files
@query("files_by_path", "SELECT c_name AS word FROM customer")
def files_by_path(spark, d):
    path = work_folder(spark, "words")
    _table(spark, d, "customer").select("c_name").write.text(path)
    text, top = schema_of(find_format("names.words"))
    s = Session(spark)
    s.add_spec("Words", text)
    s.add_files("data", path)
    return s.eval(f"data <> Words.{top}").rows().select(_text(F.col("item.word")).alias("word"))


@query("file_paths_join", "SELECT s_suppkey AS k, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def file_paths_join(spark, d):
    path = work_folder(spark, "nations")
    _table(spark, d, "nation").select("n_name", "n_nationkey").write.partitionBy("n_nationkey").text(path)
    files = spark.read.format("binaryFile").load(path).select(F.concat(F.lit("nation-"), F.regexp_extract("path", r"n_nationkey=(\d+)/", 1)).alias("path"), "content")
    named_ = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.encode(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"), F.lit("\x00?")), "UTF-8").alias("content"))
    s = _over(spark, named_, "let Schema = struct { path: NulText; [] byte; };")
    opened = s.open_files(s.eval("(data <> Spec.Schema).path").df().select("k", "value"), files)
    return opened.filter("status is null").select("k", F.rtrim(F.translate(_text(F.col("content")), "\n", "")).alias("name"))


# ---------------------------------------------------------------- more structures
_value(
    "last_capped",
    "len((data <> Spec.Capped).items)",
    _LISTS +
    ", u AS (SELECT *, list_position(n, 3) AS m FROM t) SELECT k, "
    "CAST(CASE WHEN m <= 5 THEN m WHEN len(n) >= 5 THEN 5 END AS BIGINT) AS value, CASE WHEN m <= 5 OR len(n) >= 5 THEN NULL ELSE 'out_of_bounds' END AS status FROM u",
)


@query("conditional_attributes", "SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 5 > 2 THEN 804 ELSE 1002 END AS BIGINT) AS value FROM customer")
def conditional_attributes(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.unhex(F.concat(E.u_be(F.col("c_custkey") % 5, 1), F.repeat(F.lit("AB"), 11))).alias("content"))
    spec = "let Schema = struct { a: struct { n: u8; if (n > 2) { @span: 8; } else { @span: 10; } }; b: [] byte; let ?out = sizeof a * 100 + len(b); };"
    return _over(spark, c, spec).eval("(data <> Spec.Schema).?out").df().select("k", "value")


@query("nested_conditions", "SELECT event_id, CASE WHEN event_id % 4 >= 2 THEN CASE WHEN event_id % 4 = 3 THEN user_id ELSE user_id % 256 END END AS value FROM events")
def nested_conditions(spark, d):
    kind, u = F.expr("event_id % 4"), F.col("user_id")
    body = F.when(kind < 2, F.lit("")).when(kind == 3, E.u_be(u, 4)).otherwise(E.u_be(u, 1))
    e = _table(spark, d, "events").select("event_id", F.unhex(F.concat(E.u_be(kind, 1), body)).alias("content"))
    spec = "let Schema = struct { kind: u8; if (kind >= 2) { if (kind == 3) { user: u32; } else { user: u8; } } };"
    return _over(spark, e, spec).eval("data <> Spec.Schema").df().select("event_id", F.col("value.user").alias("value"))


@query(
    "self_index",
    "SELECT k, i AS ordinal, CAST(n[i + 1] AS BIGINT) AS size FROM (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber, l_partkey, "
    "l_suppkey) AS n FROM lineitem GROUP BY 1), LATERAL (SELECT unnest(range(0, len(n))) AS i)",
)
def self_index(spark, d):
    li = _table(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    sizes = E.blobs(li, F.col("l_orderkey"), order, E.u_be(F.col("l_linenumber"), 1))
    parts = E.blobs(li, F.col("l_orderkey"), order, F.repeat(F.lit("7A"), F.col("l_linenumber").cast("int"))).withColumnRenamed("content", "parts")
    both = sizes.join(parts, "k").select("k", F.concat(F.unhex(E.u_be(F.length("content"), 1)), "content", "parts").alias("content"))
    spec = "let Schema = struct { n: u8; sizes: [n] u8; parts: [n] Part; let Part = struct { data: [sizes[index(parts, self)]] byte; }; };"
    return _over(spark, both, spec).eval("(data <> Spec.Schema).parts").rows().select("k", "ordinal", F.length("item.data").cast("long").alias("size"))


@query("span_records", "SELECT c_custkey // 100 AS k, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS ordinal, c_custkey AS id FROM customer")
def span_records(spark, d):
    rec = F.concat(E.u_be(F.col("c_custkey"), 4), F.lit("FFFFFFFF"))
    c = E.blobs(_table(spark, d, "customer"), F.expr("c_custkey div 100"), ["c_custkey"], rec)
    return _over(spark, c, "let Rec = struct { id: u32; @span: 8; };  let Schema = [] Rec;").eval("data <> Spec.Schema").rows().select("k", "ordinal", F.col("item.id").alias("id"))


@query(
    "counted_variable",
    "SELECT k, i AS ordinal, CAST(n[i + 1] AS BIGINT) AS size FROM (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber, l_partkey, "
    "l_suppkey) AS n FROM lineitem GROUP BY 1), LATERAL (SELECT unnest(range(0, len(n))) AS i)",
)
def counted_variable(spark, d):
    li = _table(spark, d, "lineitem")
    rec = F.concat(E.u_be(F.col("l_linenumber"), 1), F.repeat(F.lit("7A"), F.col("l_linenumber").cast("int")))
    packed = E.blobs(li, F.col("l_orderkey"), ["l_linenumber", "l_partkey", "l_suppkey"], rec)
    sized = packed.join(li.groupBy(F.col("l_orderkey").alias("k")).count(), "k").select("k", F.concat(F.unhex(E.u_be(F.col("count"), 1)), "content", F.unhex(F.lit("FFFF"))).alias("content"))
    spec = "let Schema = struct { n: u8; items: [n] struct { size: u8; data: [size] byte; }; [] byte; };"
    return _over(spark, sized, spec).eval("(data <> Spec.Schema).items").rows().select("k", "ordinal", F.length("item.data").cast("long").alias("size"))


@query("fixed_count", "SELECT n_nationkey AS k, n_regionkey + 3 * i AS item, i AS ordinal FROM nation, (SELECT unnest(range(0, 3)) AS i)")
def fixed_count(spark, d):
    n = _table(spark, d, "nation")
    body = F.concat(*(E.u_be(F.col("n_regionkey") + 3 * i, 2) for i in range(3)))
    blobs = n.select(F.col("n_nationkey").alias("k"), F.unhex(body).alias("content"))
    return _over(spark, blobs, "let Schema = [3] u16;").eval("data <> Spec.Schema").rows().select("k", "ordinal", "item")


@query(
    "keyed_by_ordinal",
    "WITH t AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS o FROM orders GROUP BY 1) SELECT k, o[2] AS value FROM t "
    "WHERE len(o) > 1",
)
def keyed_by_ordinal(spark, d):
    packed = E.blobs(_table(spark, d, "orders"), F.col("o_custkey"), ["o_orderkey"], E.u_be(F.col("o_orderkey"), 8))
    s = _over(spark, packed, "let Schema = [] struct { id: u64; @key: id; };")
    return s.eval("(data <> Spec.Schema)[1].id", mode="DROPMALFORMED").df().filter("status is null").select("k", "value")


@query(
    "integer_native_varint_big",
    "SELECT l_orderkey AS k, CAST(sum(l_partkey) AS BIGINT) AS native, CAST(sum(l_partkey * l_linenumber) AS BIGINT) AS big FROM "
    "lineitem GROUP BY 1",
)
def integer_native_varint_big(spark, d):
    import sys

    li, v = _table(spark, d, "lineitem"), F.col("l_partkey") * F.col("l_linenumber")
    native = (E.u_le if sys.byteorder == "little" else E.u_be)(F.col("l_partkey"), 4)
    seven = [F.shiftright(v, 7 * k).bitwiseAND(F.lit(127)) for k in (3, 2, 1, 0)]
    big = F.concat(*(E.u_be(x.bitwiseOR(F.lit(128 if k else 0)), 1) for k, x in zip((3, 2, 1, 0), seven, strict=True)))
    packed = E.blobs(li, F.col("l_orderkey"), ["l_linenumber", "l_partkey", "l_suppkey"], F.concat(native, big))
    spec = "let Schema = [] struct { a: [4] byte <> integer { @signed: false; @endian: 'native'; }; b: varint { @endian: 'big'; }; };"
    rows = _over(spark, packed, spec).eval("data <> Spec.Schema").rows()
    return rows.groupBy("k").agg(F.sum("item.a").alias("native"), F.sum("item.b").alias("big"))


@query("env_lookup", "SELECT r_regionkey AS k, CAST(r_regionkey * 7 AS BIGINT) AS value FROM region")
def env_lookup(spark, d):
    r = _table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.unhex(E.u_be(F.col("r_regionkey"), 1)).alias("content"))
    s = _over(spark, r, "let Schema = struct { x: u8; };")
    s.add_expr("factor", "3 + 4")
    return s.eval("(data <> Spec.Schema).x * env('factor')").df().select("k", F.col("value").cast("long").alias("value"))


@query("extern_function", "SELECT n_nationkey AS k, CAST(n_nationkey * 42 AS BIGINT) AS value FROM nation")
def extern_function(spark, d):
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.unhex(E.u_be(F.col("n_nationkey"), 1)).alias("content"))
    s = Session(spark)
    s.register_function("answer", _answer)
    s.add_spec("Spec", BASE + "extern answer;  let Schema = struct { x: u8; let ?times = x * answer; };")
    s.add_data_source("data", n)
    return s.eval("(data <> Spec.Schema).?times").df().select("k", "value")


# ---------------------------------------------------------------- formats and codecs
@query("snappy_copies", "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, md5(html) AS digest FROM pages")
def snappy_copies(spark, d):
    @F.pandas_udf("binary")
    def packed(t: pd.Series) -> pd.Series:
        import pyarrow as pa

        return t.map(lambda x: pa.compress(x.encode(), codec="snappy", asbytes=True))

    pages = _table(spark, d, "pages").select("page_id", packed("html").alias("content"))
    v = _over(spark, pages, "let Schema = snappy;").eval("data <> Spec.Schema").df()
    return v.select("page_id", F.length("value").cast("long").alias("n"), F.md5("value").alias("digest"))


@query("gzip_files", "SELECT doc_id, md5(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS size, 'doc' || doc_id AS name FROM documents")
def gzip_files(spark, d):
    @F.arrow_udf("binary")
    def packed(name: pa.Array, t: pa.Array) -> pa.Array:
        import gzip
        import io

        def one(n, x):
            f = io.BytesIO()
            with gzip.GzipFile(n, "wb", 6, f, 0) as g:
                g.write(x.encode())
            return f.getvalue()

        return pa.array((one(n.as_py(), x.as_py()) for n, x in zip(name, t, strict=True)), pa.binary())

    docs = _table(spark, d, "documents").select("doc_id", packed(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), "text").alias("content"))
    s = Session(spark)
    s.add_spec("Gzip", schema_of(find_format(extension="gz"))[0])
    s.add_data_source("data", docs)
    v = s.eval("(data <> Gzip.File).members[0]").df().select("doc_id", "value.*")
    return v.select("doc_id", F.md5("blocks").alias("digest"), F.col("trailer.isize").alias("size"), _text(F.col("name")).alias("name"))


@query(
    "tar_files",
    "SELECT source || '-' || doc_id // 500 AS archive, 'doc' || doc_id AS name, md5(text) AS digest, CAST(octet_length(encode(text)) AS "
    "BIGINT) AS size FROM documents",
)
def tar_files(spark, d):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import tarfile

        f = io.BytesIO()
        with tarfile.open(fileobj=f, mode="w", format=tarfile.USTAR_FORMAT) as t:
            for i, x in zip(pdf["doc_id"], pdf["text"], strict=True):
                info = tarfile.TarInfo(f"doc{i}")
                info.size = len(x.encode())
                t.addfile(info, io.BytesIO(x.encode()))
            end = t.offset
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "content": [f.getvalue()[:end]]})

    archive = F.concat_ws("-", "source", F.expr("doc_id div 500")).alias("archive")
    archives = _table(spark, d, "documents").select("doc_id", archive, "text").groupBy("archive").applyInPandas(pack, "archive string, content binary")
    s = Session(spark)
    s.add_spec("Tar", schema_of(find_format("a.tar"))[0])
    s.add_data_source("data", archives)
    rows = s.eval("(data <> Tar.File).files").rows()
    return rows.select("archive", _text(F.col("item.name")).alias("name"), F.md5("item.contents").alias("digest"), F.col("item.size").alias("size"))


# ---------------------------------------------------------------- paths, order, dumps
@query("cursor_path", _LAST + "SELECT k, 'recs[1].k' AS dpath, o[2] AS key FROM t WHERE len(o) > 1")
def cursor_path(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("data <> Spec.Schema").nodes()
    return at_path(n, "recs[1].k").select("k", "dpath", F.col("v_int").alias("key"))


@query("cursor_reverse", _LAST + "SELECT k, o[-1] AS last, o[-2] AS before FROM t WHERE len(o) > 1")
def cursor_reverse(spark, d):
    n = _over(spark, _orders(spark, d), _ORDERS).eval("(data <> Spec.Schema).recs").nodes()
    back = reverse(n.filter("name = 'k'")).groupBy("k").agg(F.reverse(F.array_sort(F.collect_list(F.struct("node_id", "v_int")))).alias("l"))
    return back.filter("size(l) > 1").select("k", F.col("l")[0]["v_int"].alias("last"), F.col("l")[1]["v_int"].alias("before"))


def _region_dump(form: str):
    def run(spark, d):
        r = _table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.unhex(F.concat(E.u_be(F.col("r_regionkey"), 1), E.text(F.col("r_name")))).alias("content"))
        return _over(spark, r, "let Schema = struct { id: u8; name: string; };").eval("data <> Spec.Schema").text(form).select("k", form)

    return run


query("dump_yaml", "SELECT r_regionkey AS k, 'id: ' || r_regionkey || chr(10) || 'name: ' || r_name || chr(10) AS yaml FROM region")(_region_dump("yaml"))
query("dump_python", "SELECT r_regionkey AS k, translate('{`id`: ' || r_regionkey || ', `name`: b`' || r_name || '`}', '`', chr(39)) AS python FROM region")(_region_dump("python"))


# ---------------------------------------------------------------- more formats
def _format(spark, df: DataFrame, name: str) -> Session:
    s = Session(spark)
    s.add_spec("Format", schema_of(name)[0])
    s.add_data_source("data", df)
    return s


@query("key_value_log_files", 'SELECT c_custkey // 100 AS k, c_name AS "key", CAST(c_nationkey AS VARCHAR) AS value FROM customer')
def key_value_log_files(spark, d):
    sized = lambda c: F.concat(E.u_be(F.octet_length(c), 4), E.text(c))
    pair = F.concat(F.lit("00"), sized(F.col("c_name")), sized(F.col("c_nationkey").cast("string")))
    logs = E.blobs(_table(spark, d, "customer"), F.expr("c_custkey div 100"), ["c_custkey"], pair)
    rows = _format(spark, logs, "key_value_log").eval("(data <> Format.File).log").rows()
    return rows.select("k", _text(F.col("item.key.text")).alias("key"), _text(F.col("item.value.text")).alias("value"))


@query(
    "block_log_files",
    "SELECT o_orderkey // 500 AS k, row_number() OVER (PARTITION BY o_orderkey // 500 ORDER BY o_orderkey) - 1 AS ordinal, o_custkey AS "
    "cust FROM orders",
)
def block_log_files(spark, d):
    rec = F.concat(F.lit("00000000"), E.u_le(F.lit(8), 2), F.lit("01"), E.u_be(F.col("o_custkey"), 8))
    logs = E.blobs(_table(spark, d, "orders"), F.expr("o_orderkey div 500"), ["o_orderkey"], rec)
    rows = _format(spark, logs, "block_log").eval("(data <> Format.File).blocks[0].fragments").rows()
    return rows.select("k", "ordinal", F.conv(F.hex("item.data"), 16, 10).cast("long").alias("cust"))


@query("ogg_files", "SELECT l_orderkey // 100 AS k, l_orderkey AS page, count(*) AS segments, CAST(sum(l_linenumber) AS BIGINT) AS bytes FROM lineitem GROUP BY 1, 2")
def ogg_files(spark, d):
    li, order = _table(spark, d, "lineitem"), ["l_linenumber", "l_partkey", "l_suppkey"]
    sizes = E.blobs(li, F.col("l_orderkey"), order, E.u_be(F.col("l_linenumber"), 1))
    bodies = E.blobs(li, F.col("l_orderkey"), order, F.repeat(F.lit("7A"), F.col("l_linenumber").cast("int"))).withColumnRenamed("content", "body")
    zero = F.lit(0)
    page = F.concat(E.text(F.lit("OggS")), F.lit("0002"), E.u_le(zero, 8), E.u_le(F.lit(9), 4), E.u_le(F.col("k"), 4), E.u_le(zero, 4), E.u_be(F.length("content"), 1), F.hex("content"), F.hex("body"))
    pages = sizes.join(bodies, "k").select(F.col("k").alias("o"), page.alias("page"))
    files = E.blobs(pages, F.expr("o div 100"), ["o"], F.col("page"))
    rows = _format(spark, files, "ogg").eval("(data <> Format.File).pages").rows()
    size = F.aggregate("item.body", F.lit(0), lambda a, x: a + F.length(x["packet_data"]))
    return rows.select("k", F.col("item.sequence_number").alias("page"), F.size("item.body").cast("long").alias("segments"), size.cast("long").alias("bytes"))


def _box(kind: str, body):
    return F.concat(E.u_be(F.length(body) / 2 + 8, 4), E.text(F.lit(kind)), body)


@query("mp4_files", "SELECT n_nationkey AS k, CAST(n_regionkey AS BIGINT) AS timescale, CAST(n_nationkey * 1000 AS BIGINT) AS duration, n_name AS handler FROM nation")
def mp4_files(spark, d):
    zeros = lambda n: F.lit("00" * n)
    mdhd = _box("mdhd", F.concat(F.lit("01000000"), zeros(16), E.u_be(F.col("n_regionkey"), 4), E.u_be(F.col("n_nationkey") * 1000, 8), zeros(4)))
    hdlr = _box("hdlr", F.concat(zeros(8), E.text(F.lit("vide")), zeros(12), E.text(F.col("n_name")), zeros(1)))
    files = F.concat(_box("ftyp", F.concat(E.text(F.lit("isom")), zeros(4))), _box("moov", _box("trak", _box("mdia", F.concat(mdhd, hdlr)))))
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.unhex(files).alias("content"))
    s = _format(spark, n, "mp4")
    s.add_expr("media", "(data <> Format.File).boxes['moov'].boxes['trak'].boxes['mdia'].boxes")
    get = lambda e, name: s.eval(f"media{e}").df().select("k", F.col("value").alias(name))
    both = get("['mdhd'].time.timescale", "timescale").join(get("['mdhd'].time.duration", "duration"), "k").join(get("['hdlr'].name", "handler"), "k")
    return both.select("k", F.col("timescale").cast("long").alias("timescale"), F.col("duration").cast("long").alias("duration"), _text(F.col("handler").cast("binary")).alias("handler"))


@query("sorted_table_files", 'SELECT n_regionkey AS k, n_name AS "key", n_nationkey AS value FROM nation')
def sorted_table_files(spark, d):
    name, crc = F.col("n_name"), F.lit("00000000")
    row = F.concat(F.lit("00"), E.varint(F.octet_length(name)), F.lit("01"), E.text(name), E.u_be(F.col("n_nationkey"), 1))
    store = lambda rows: F.concat(rows, F.lit("00000000"), E.u_le(F.lit(1), 4))
    data = E.blobs(_table(spark, d, "nation"), F.col("n_regionkey"), ["n_name", "n_nationkey"], row).select("k", store(F.hex("content")).alias("data"))
    handle = F.concat(F.lit("00"), E.varint(F.length("data") / 2))
    both = data.withColumn("index", store(F.concat(F.lit("0001"), E.varint(F.length(handle) / 2), E.text(F.lit("z")), handle)))
    foot = F.concat(F.rpad(F.concat(F.lit("0000"), E.varint(F.length("data") / 2 + 5), E.varint(F.length("index") / 2)), 80, "0"), E.text(F.lit("magicnum")))
    files = both.select("k", F.unhex(F.concat("data", F.lit("00"), crc, "index", F.lit("00"), crc, foot)).alias("content"))
    rows = _format(spark, files, "sorted_table").eval("(data <> Format.File).?index.rows[0].?rows.rows").rows()
    return rows.select("k", _text(F.col("item.key_delta")).alias("key"), F.conv(F.hex("item.value"), 16, 10).cast("int").alias("value"))
