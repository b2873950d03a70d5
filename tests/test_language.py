import pytest
from blobs import blob
from hypothesis import given, settings
from hypothesis import strategies as st

from bytetree.decode import codecs
from bytetree.decode.board import Board, builtin_names, evaluate_constant
from bytetree.errors import DataError, ExprError, NoDataError, NoItemError, NotContainerError, OutOfBoundsError, PathError, Unsupported
from bytetree.formats import FORMATS, find_format

INTS = """
let Big = integer { @signed: false; @endian: 'big'; };
let u8 = byte <> Big; let u16 = [2] byte <> Big; let u32 = [4] byte <> Big; let s8 = byte <> integer { @signed: true; };
let u32l = [4] byte <> integer { @signed: false; @endian: 'little'; };
let Nul = string { @boundary: '\\0'; };  let Line = string { @boundary: '\\n'; };
"""


def case(spec, data):
    b = Board()
    b.add_data_source("data", data if isinstance(data, bytes) else blob(data))
    b.add_spec("Spec", INTS + spec)
    tree = b.eval("data <> Spec.Schema")
    return lambda e: b.read(e, tree)


@pytest.mark.parametrize("text,value", [("0", 0), ("017", 15), ("0x1F", 31), ("9223372036854775807", 2**63 - 1), ("'a' \"b\"", b"ab"), (r"'\x41\101\n\0\q'", b"AA\n\0q"), ("true", True), ("1 + 2 * 3", 7), ("-7 / 2", -3), ("-7 % 2", -1), ("1 << 65", 2), ("-8 >> 1", -4), ("9223372036854775807 + 1", -(2**63)), ("1 | 6 & 3 ^ 1", 3), ("!(1 < 2) || 3 >= 3", True), ("~5", -6), ("- -5", 5), ("'a' == 'a' && 'a' != 'b'", True), ("/* c */ 1 // d", 1)])
def test_constants(text, value):
    got = evaluate_constant(text)
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("text", ["08", "42a", "9223372036854775808", "'open", "nothing", "1 +", "1 == true", "'a' < 'b'", "!1", "1 && 2", "len(1)", "sizeof(1)", "$", "[1"])
def test_bad_expressions(text):
    with pytest.raises(ExprError):
        evaluate_constant(text)


def test_division_by_zero():
    with pytest.raises(DataError):
        evaluate_constant("1 / 0")


@given(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1))
@settings(max_examples=50, deadline=None)
def test_wrapping(a, b):
    board = Board()
    for op, f in (("+", a + b), ("-", a - b), ("*", a * b)):
        assert board.rt.read(board.rt.evaluate(f"({a + 1} - 1) {op} ({b + 1} - 1)" if min(a, b) > -(2**63) and max(a, b) < 2**63 - 1 else "0")) in (codecs.wrap(f), 0)


@pytest.mark.parametrize("data,size,value", [("00", 1, 0), ("7f", 1, 127), ("80 01", 2, 128), ("ac 02", 2, 300), ("ff ff ff ff ff ff ff ff ff 01", 10, -1)])
def test_varint(data, size, value):
    raw = blob(data)
    assert codecs.varint_size(raw + b"\0", 0, len(raw) + 1) == size and codecs.varint(raw, None) == value


def test_varint_big_and_bad():
    assert codecs.varint(blob("82 2c"), b"big") == 300
    with pytest.raises(DataError):
        codecs.varint(b"\x80\x80", None)


@pytest.mark.parametrize("text,value", [(b"", b""), (b"Wg==", b"Z"), (b"aG9sYQ==", b"hola")])
def test_base64(text, value):
    assert codecs.base64_decode(text) == value


@pytest.mark.parametrize("text", [b"Wg=", b"Wg= ", b"W===", b"Wg==aaaa", b"W\n=="])
def test_bad_base64(text):
    with pytest.raises(DataError):
        codecs.base64_decode(text)


@pytest.mark.parametrize("text,how,value", [(b"42", {}, 42), (b"--5", {}, 5), (b"+-5", {}, -5), (b"ff", {"base": 16}, 255), (b"", {"empty": 7}, 7), (b"9223372036854775807", {}, 2**63 - 1)])
def test_formatted_integer(text, how, value):
    assert codecs.formatted_integer(text, **how) == value


@pytest.mark.parametrize("text,how", [(b"", {}), (b"8", {"base": 8}), (b"-1", {"signed": False}), (b"9223372036854775808", {}), (b"12efg", {}), (b"-", {})])
def test_bad_formatted_integer(text, how):
    with pytest.raises(DataError):
        codecs.formatted_integer(text, **how)


def test_snappy_and_deflate():
    import zlib

    assert codecs.snappy_decode(blob("09 08 'abc' 09 03")) == b"abcabcabc"
    for bad in (blob("09 08 'ab'"), blob("05 08 'abc'"), blob("04 01 09")):
        with pytest.raises(DataError):
            codecs.snappy_decode(bad)
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    z = c.compress(b"x" * 1000) + c.flush()
    assert codecs.inflate(z + b"junk", 1000) == b"x" * 1000
    for n in (999, 1001):
        with pytest.raises(DataError):
            codecs.inflate(z, n)


STRESS = """
let Schema = struct { huge: [] H; big: [] B; avg: [] A; small: [] S; };
let V = struct { n: u8; x: [n] byte; };
let H = struct { v: [] V; %s };  let B = struct { v: [] V; %s };  let A = struct { v: [] V; %s };  let S = struct { v: [] V; %s };
"""
_FIXED = bytes([10, *[1] * 10, 9, *[1] * 9, 8, *[1] * 8, 2, 2, 2, 3, 2, 2, 2, 2, 2, 2, 1, 2, 1, 2, 4, 2, 2, 2, 2, 0, 2, 3, 3, 0, 0, 0, 0, 1, 3])
_RANGED = bytes([10, *[1] * 10, 9, *[1] * 9, 6, *[1] * 6, 6, *[1] * 6, 3, 1, 1, 1, 3, 1, 1, 1, *[1, 1] * 3, 0, 2, 1, 1, 1, 1, 4, 2, 2, 2, 2, 3, 2, 2, 2, 2, 3, 3])


@pytest.mark.parametrize(
    "spans,data,counts",
    [
        (tuple(f"@span: {n};" for n in (100, 30, 10, 3)), _FIXED, [0, 1, 2, 3]),
        (tuple(f"@minspan: {n}; @maxspan: {n};" for n in (100, 30, 10, 3)), _FIXED, [0, 1, 2, 3]),
        (tuple(f"@minspan: {n};" for n in (100, 30, 10, 3)), _FIXED, [0, 1, 0, 0]),
        (tuple(f"@minspan: 0; @maxspan: {n};" for n in (100, 30, 10, 3)), _FIXED, [1, 0, 0, 0]),
        (tuple(f"@minspan: {a}; @maxspan: {b};" for a, b in ((90, 110), (26, 28), (8, 9), (3, 3))), _RANGED, [0, 2, 1, 1]),
    ],
)
def test_four_greedy_arrays(spans, data, counts):
    read = case(STRESS % spans, data)
    assert [read(f"len({n})") for n in ("huge", "big", "avg", "small")] == counts


def test_chained_filters_and_ancestors():
    import base64

    texts = [b"as contents data", b"more contents data", b"even more contents data"]
    lines = b"".join(base64.b64encode(len(t).to_bytes(4, "little") + t) + b"\n" for t in texts)
    read = case("let Block = Line <> base64 <> struct { n: u32l; [n] byte <> Body; };  let Schema = struct { blocks: [] Block; };  let Body = struct { data: [] byte; let ?start = data[..4]; let ?part = data[5..][2..5]; };", lines)
    assert [read(f"blocks[{i}].data") for i in range(3)] == texts
    assert read("blocks[1]") == {"n": 18, "data": texts[1]} and read("blocks[-1].?start") == b"even" and read("blocks[1].?part") == texts[1][7:10]
    assert (read("&blocks[1]"), read("sizeof blocks[1]")) == (0, 22)
    assert read("^blocks[1]") == b"\x12\0\0\0" + texts[1] and read("^^blocks[1]") == read("^^^^blocks[1]") == lines.split()[1]
    assert read("&^^blocks[1]") == 29 and read("sizeof ^^blocks[1]") == 32 and read("^^blocks[1..][1]") == lines.split()[2]
    with pytest.raises(NoItemError):
        read("blocks[3]")


def test_arrays_last_and_slices():
    read = case("let Item = struct { v: u8; @last: v == 9; };  let Schema = struct { items: [] Item; rest: [] byte; let ?all = items; };", bytes([*range(10), 255, 255]))
    assert read("len(items)") == 10 and read("items[-1].v") == 9 and read("len(rest)") == 2
    assert read("items[2..5][1..][0].v") == 3 and read("index(items, items[2..][3])") == 5
    for bad in ("items[5..2]", "items[11..]", "items[10]", "items[-11]"):
        with pytest.raises(PathError):
            read(bad)


def test_keys_and_twins():
    names = ["alpha", "bravo", "charlie", "delta"]
    rows = [(n, i) for k, n in enumerate(names) for i in range(k + 1)]
    data = b"".join(n.encode() + b"\0" + bytes([i]) for n, i in rows)
    read = case("let Schema = [] struct { name: Nul; v: u8; @key: name; };", data)
    assert read("self['charlie'{2}].v") == 2 and read("self['delta'].v") == 0 and read("index(self, self['charlie'])") == 3
    assert read("self[4].v") == 1 and read("self['bravo'..'delta'][0].name") == b"bravo" and read("self[2..]['bravo'].v") == 1
    for bad in ("self['echo']", "self['alpha'{1}]"):
        with pytest.raises(NoItemError):
            read(bad)


@pytest.mark.parametrize(
    "spec,data,body,tail",
    [
        ("struct { c: [] byte; f: [6] byte <> string; }", b"sixteen chars...footer", b"sixteen chars...", b"footer"),
        ("struct { c: [] byte; f: struct { t: [6] byte <> string; n: u8; @span: 7; }; let ?t = f.t; }", b"abcfooter\x05", b"abc", None),
        ("struct { c: [] byte; f: [n] byte <> string; n: u8; }", b"sixteen chars...footer\x06", b"sixteen chars...", b"footer"),
        ("struct { n: u8; c: [] byte; f: [n] byte <> string; }", b"\x06abcdefooter", b"abcde", b"footer"),
    ],
)
def test_footers(spec, data, body, tail):
    read = case(f"let Schema = {spec};", data)
    assert read("c") == body and (tail is None or read("f") == tail)


def test_lazy_errors():
    read = case("let Schema = struct { size: Line <> formatted_integer; text: [size] byte; };", b"12x\nabc")
    assert read("^size") == b"12x"
    with pytest.raises(DataError):
        read("size")
    read = case("let Schema = struct { n: u32l; d: [n] byte; };", blob("ff 00 00 00 'abc'"))
    assert read("n") == 255
    with pytest.raises(OutOfBoundsError):
        read("d")
    read = case("let Schema = struct { a: [2] byte <> integer { @signed: false; }; b: [3] byte <> Big; c: u8; };", b"\1\2\3\4\5\6")
    assert read("c") == 6
    with pytest.raises(DataError):
        read("a")
    with pytest.raises(Unsupported):
        read("b")


def test_conditions_anonymous_union():
    spec = """let Schema = struct {
        kind: [8] byte <> Nul;
        if (kind == "int") { value: u32; } else if (kind == "text") { value: [4] byte <> string; } else { value: [4] byte; }
        struct { a: u8; struct { b: u8; }; }; [2] byte;
        u: union { whole: u16; high: u8; };
        let self_size = sizeof(u);
    };"""
    for kind, want in (("int", 0x61626364), ("text", b"abcd"), ("raw", b"abcd")):
        read = case(spec, kind.encode().ljust(8, b"\0") + b"abcd" + bytes([1, 2, 9, 9, 3, 4]))
        assert read("value") == want and (read("a"), read("b")) == (1, 2) and read("u") == {"whole": 0x304, "high": 3}
        assert set(read("self")) == {"kind", "value", "a", "b", "u"} and read("len(self)") == 5 and read("self_size") == 2
    with pytest.raises(ExprError):
        read("nope")
    with pytest.raises(NotContainerError):
        read("a.x")


def test_scopes():
    read = case(
        """let Schema = struct { n: u8; things: [n] Thing; pool: [] byte;
            let Thing = struct { at: u8; size: u8; let ?name = pool[at .. at + size]; let n = 7; let ?outer = Schema::n; };
            let ?first = things[0].?name; };""",
        bytes([2, 0, 3, 3, 2]) + b"abcde",
    )
    assert read("things[1].?name") == b"de" and read("?first") == b"abc" and read("things[0].?outer") == 2 and read("things[0].n") == 7


def test_named_values_that_differ_by_row():
    spec = "let Schema = [] struct { f: u8; x: u16; if (f == 1) { let ?v = x; } else { let ?v = ^x; } };"
    read = case(spec, blob("01 00 05 02 00 06"))
    assert read("self[0].?v") == 5 and read("self[1].?v") == b"\0\6"


def test_data_driven_endianness():
    read = case("let Schema = struct { f: u8; if (f == 0) { let e = 'big'; } if (f == 1) { let e = 'little'; } if (f > 1) { let e = 'sideways'; } v: [] N; let N = [2] byte <> integer { @signed: false; @endian: e; }; };", blob("01 01 00 02 00"))
    assert read("v") == [1, 2]
    with pytest.raises(DataError):
        case("let Schema = struct { v: [2] byte <> integer { @signed: false; @endian: 'sideways'; }; };", b"\0\1")("v")


RADIO = ["alfa", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
_pool = "".join(RADIO).encode()
_at = [sum(map(len, RADIO[:i])) for i in range(len(RADIO))]


@pytest.mark.parametrize(
    "spec,data",
    [
        ("[] struct { name: [8] byte <> Nul; }", b"".join(w.encode().ljust(8, b"\0") for w in RADIO)),
        ("struct { n: u32; a: [n] struct { name: [8] byte <> Nul; }; }", b"\0\0\0\x08" + b"".join(w.encode().ljust(8, b"\0") for w in RADIO)),
        ("struct { n: u32; a: [n] struct { size: u8; name: [size] byte <> string; }; }", b"\0\0\0\x08" + b"".join(bytes([len(w)]) + w.encode() for w in RADIO)),
        ("[] struct { [5] byte; name: Nul; [] byte; x: [3] byte; @span: 16; }", b"".join(b"....." + (w.encode() + b"\0").ljust(8, b"-") + b"xyz" for w in RADIO)),
        ("[] struct { [2] byte; size: u16; name: [] byte <> Nul; @span: size; }", b"".join(b"::" + (len(w) + 7).to_bytes(2, "big") + w.encode() + b"\0zz" for w in RADIO)),
        ("struct { n: u32; sizes: [n] u8; a: [n] Entry;  let Entry = struct { name: [?s] byte <> string; let ?s = sizes[index(a, self)]; }; }", b"\0\0\0\x08" + bytes(map(len, RADIO)) + _pool),
        ("struct { n: u32; a: [n] struct { at: u8; size: u8; let name = pool[at .. at + size]; }; pool: [] byte; }", b"\0\0\0\x08" + b"".join(bytes([p, len(w)]) for p, w in zip(_at, RADIO, strict=True)) + _pool),
        ("struct { a: [] struct { name: [8] byte <> Nul; @last: name == 'hotel'; }; junk: [] byte; }", b"".join(w.encode().ljust(8, b"\0") for w in RADIO) + b"junkjunkjunk"),
        ("[] struct { name: Line; }", "\n".join(RADIO).encode()),
    ],
)
def test_one_list_in_nine_layouts(spec, data):
    read = case(f"let Schema = {spec};", data)
    a = "a" if "struct {" in spec[:9] else "self"
    assert [read(f"{a}[{i}].name") for i in range(len(RADIO))] == [w.encode() for w in RADIO]
    assert read(f"len({a})") == 8 and read(f"{a}[-1].name") == b"hotel" and read(f"{a}[2..5][1].name") == b"delta"


@pytest.mark.parametrize("spec", ["let A = Missing;", "let S = struct { a: [n] byte; };", "let S = struct { s: S; };", "let A = struct { b: B; }; let B = struct { a: [2] A; };", "let A = B; let B = A;", "let S = struct { a: integer { }; };", "let S = struct { @maxspan: 2; a: [4] byte; };", "let S = struct { @wrong: 2; };", "let S = struct { a byte; };", "let S = struct { a: byte }"])
def test_rejected_schemas(spec):
    with pytest.raises(OSError):
        Board().add_spec("S", spec)


@pytest.mark.parametrize("spec", ["let A = struct { n: byte <> integer { @signed: false; }; kids: [] A; };", "let A = struct { b: B; let B = [2] byte; };", "let S = struct { a: x; let x = y; let y = byte; };", "let S = struct { let T = S; a: byte; };"])
def test_accepted_schemas(spec):
    Board().add_spec("S", spec)


def test_board_names():
    b = Board()
    b.use_spec("let T = [2] byte;")
    b.add_data_source("d", b"abcd")
    b.add_expr("half", "d <> T")
    assert b.read("half") == b"ab" and b.read("env('half')") == b"ab" and "half" in b.names()
    with pytest.raises(NoDataError):
        b.read("T")
    b.register_function("answer", lambda: 42)

    class Upper:
        def read(self, data):
            return bytes(data).upper()

    b.register_filter("upper", Upper)
    assert b.read("answer") == 42 and b.read("d <> upper") == b"ABCD"
    b.remove("half")
    with pytest.raises(ExprError):
        b.read("half")
    assert "string" in builtin_names("str") and find_format("x/y.tar") == "tar" and find_format(mimetype="video/mp4") == "mp4"


def format_board(name, data):
    b = Board()
    b.add_spec("F", FORMATS[name][0])
    b.add_data_source("d", data)
    return lambda e: b.read(f"(d <> F.{FORMATS[name][1]}){e}")


def test_gzip_members():
    import gzip
    import io
    import zlib

    f = io.BytesIO()
    with gzip.GzipFile("story.txt", "wb", fileobj=f, mtime=77) as g:
        g.write(b"hello " * 100)
    read = format_board("gzip", f.getvalue())
    assert read(".members[0].blocks") == b"hello " * 100 and read(".members[0].name") == b"story.txt" and read(".members[0].fixed.mtime") == 77
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = z.compress(b"abc") + z.flush()
    head = bytes([31, 139, 8, 2 | 4 | 16, 0, 0, 0, 0, 0, 3]) + b"\6\0ab\2\0xy" + b"note\0" + b"\x34\x12"
    read = format_board("gzip", head + body + zlib.crc32(b"abc").to_bytes(4, "little") + b"\3\0\0\0")
    assert read(".members[0].extra.subfields[0].data") == b"xy" and read(".members[0].comment") == b"note" and read(".members[0].crc16") == 0x1234
    assert read(".members[0].blocks") == b"abc" and read(".members[0].trailer.crc32") == zlib.crc32(b"abc")


def test_tar_entries():
    import io
    import tarfile

    f = io.BytesIO()
    with tarfile.open(fileobj=f, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for n, size in (("one", 700), ("two", 1024), ("none", 0)):
            i = tarfile.TarInfo(n)
            i.size, i.uid, i.uname, i.mtime = size, 12, "me", 99
            t.addfile(i, io.BytesIO(n.encode() * 600))
    read = format_board("tar", f.getvalue()[: (2 + 1 + 2 + 1 + 1) * 512])
    assert read(".files['one'].contents") == (b"one" * 600)[:700] and read(".files['two'].size") == 1024 and read(".files['none'].size") == 0
    assert read(".files[1].uid") == 12 and read(".files[-1].mtime") == 99 and read(".files[0].uname") == b"me"


def test_sorted_table_blocks():
    row = lambda key, value, shared=0: bytes([shared, len(key), len(value)]) + key + value
    block = lambda *rows: b"".join(rows) + b"\0\0\0\0" + b"\1\0\0\0"
    snap = lambda b: bytes([len(b), (len(b) - 1) << 2]) + b
    for packed in (False, True):
        store = (lambda b: snap(b) + b"\1crc.") if packed else (lambda b: b + b"\0crc.")
        first, second = store(block(row(b"apple", b"1"), row(b"ly", b"2", 3))), store(block(row(b"pear", b"3")))
        index = store(block(row(b"b", bytes([0, len(first) - 5])), row(b"q", bytes([len(first), len(second) - 5]))))
        at = len(first) + len(second)
        foot = bytes([0, 0, at, len(index) - 5]).ljust(40, b"\0") + b"magicnum"
        read = format_board("sorted_table", first + second + index + foot)
        assert read(".?index.rows[1].key_delta") == b"q" and read(".?index.rows[1].?rows.rows[0].value") == b"3"
        assert read(".?index.rows[0].?rows.rows[1]")["key_delta"] == b"ly" and read(".?index.n_restarts") == 1 and read(".magic") == b"magicnum"


def test_block_log_fragments():
    log = b"".join(b"crc." + len(x).to_bytes(2, "little") + b"\1" + x for x in [b"a" * 43] * 655) + b"crc." + b"\4\0\1last" + b"\0" * 7
    assert len(log) == 32768
    read = format_board("block_log", log[:-7] + b"\0" * 7 + b"crc." + b"\3\0\1abc")
    assert read(".blocks[1].fragments[0].data") == b"abc" and read(".blocks[0].fragments[655].data") == b"last" and read(".blocks[0].fragments[654].length") == 43


def test_mp4_boxes():
    box = lambda code, x: (len(x) + 8).to_bytes(4, "big") + code + x
    n = lambda *v: b"".join(x.to_bytes(4, "big") for x in v)
    mvhd = box(b"mvhd", n(0, 1, 2, 600, 1200) + n(65536) + b"\1\0" + bytes(10) + n(*range(9)) + bytes(24) + n(2))
    mdhd = box(b"mdhd", b"\1\0\0\0" + bytes(15) + b"\5" + n(48000) + bytes(7) + b"\7" + b"\x55\xc4\0\0")
    stbl = box(b"stbl", box(b"stts", n(0, 2, 3, 4, 5, 6)) + box(b"stsz", n(0, 0, 2, 11, 12)) + box(b"co64", n(0, 1, 1, 2)))
    data = box(b"ftyp", b"isom\0\0\0\1mp42iso2") + box(b"moov", mvhd + box(b"trak", box(b"mdia", mdhd + box(b"hdlr", n(0, 0) + b"vide" + bytes(12) + b"me\0") + box(b"minf", stbl)))) + n(1) + b"mdat" + n(0, 19) + b"abc" + n(0) + b"free" + b"tail"
    read = format_board("mp4", data)
    assert read(".boxes[0].compatible_brands") == [b"mp42", b"iso2"] and read(".boxes['moov'].boxes['mvhd'].time.duration") == 1200 and read(".boxes['moov'].boxes['mvhd'].next_track_id") == 2
    inner = ".boxes['moov'].boxes['trak'].boxes['mdia'].boxes"
    assert read(inner + "['mdhd'].time") == {"creation": 0, "modification": 5, "timescale": 48000, "duration": 7} and read(inner + "['hdlr'].handler_type") == b"vide"
    tables = inner + "['minf'].boxes['stbl'].boxes"
    assert read(tables + "['stts'].runs.list[1].sample_delta") == 6 and read(tables + "['stsz'].entry_sizes") == [11, 12] and read(tables + "['co64'].chunk_offsets") == [(1 << 32) + 2]
    assert read(".boxes['mdat'].payload") == b"abc" and read(".boxes['free'].payload") == b"tail"


def test_ogg_pages_key_value_log_and_words():
    page = b"OggS\0\2" + (5).to_bytes(8, "little") + (9).to_bytes(4, "little") + bytes(8) + b"\2\1\2abb"
    read = format_board("ogg", page + page.replace(b"\2\1\2abb", b"\1\3xyz"))
    assert read(".pages[0].body[1].packet_data") == b"bb" and read(".pages[1].body[0].packet_data") == b"xyz" and read(".pages[1].serial_number") == 9
    pair = lambda k, v: b"\0" + len(k).to_bytes(4, "big") + k + len(v).to_bytes(4, "big") + v
    read = format_board("key_value_log", pair(b"a", b"1") + pair(b"bb", b"22") + pair(b"a", b"333"))
    assert read(".log['a'{1}].value.text") == b"333" and read(".log['bb'].value.length") == 2
    assert format_board("word_list", b"one\ntwo\n")("['two'].word") == b"two"


@given(st.lists(st.tuples(st.binary(max_size=20), st.integers(0, 2**32 - 1)), max_size=20))
@settings(max_examples=40, deadline=None)
def test_round_trip(rows):
    data = b"".join(bytes([len(t)]) + t + v.to_bytes(4, "big") for t, v in rows)
    read = case("let Schema = struct { r: [] struct { n: u8; t: [n] byte; v: u32; }; };", data)
    assert read("r") == [{"n": len(t), "t": t, "v": v} for t, v in rows]


def test_items_behave_like_values():
    from bytetree.item import IndexKey, Item, Spec, read

    b = Board()
    b.add_spec("F", "let U = integer { @signed: false; @endian: 'big'; };  let Rec = struct { k: byte <> string; n: byte <> U; @key: k; };  let File = struct { size: byte <> U; recs: [] Rec; };")
    b.add_data_source("d", b"\x05a\x01b\x02a\x03")
    top = read(b, "d <> F.File")
    assert isinstance(top, Item) and list(top) == ["size", "recs"] and list(top.iter_keys()) == ["size", "recs"] and top["size"] == 5
    assert top.size + 1 == 6 and 2 * top.size == 10 and -top.size == -5 and divmod(top.size, 2) == (2, 1) and top.size < 6 and hash(top.size) == hash(5) and int(top.size) == 5
    recs = top.recs
    assert len(recs) == 3 and recs[-1].n == 3 and recs["b"].n == 2 and recs[("a", 1)].n == 3 and [int(x.n) for x in recs[("a", "*")]] == [1, 3] and recs[("b",)].n == 2
    assert [str(k) for k in recs.iter_keys()] == ['"a"', '"b"', '"a"{1}'] and list(recs.iter_keys())[2] == IndexKey(b"a", 1)
    assert [x.value for x in recs[1:9]] == [{"k": b"b", "n": 2}, {"k": b"a", "n": 3}] and len(recs[2:1]) == 0 and [k for k, _ in recs.iter_items()][1] == "b"
    with pytest.raises(ExprError):
        recs[::2]
    with pytest.raises(AttributeError):
        top.nothing
    assert recs[1].get_location() == (3, 2) and recs[1].get_size() == 2 and recs[1].get_offset() == 3 and recs.get_filter_type() == "array" and recs.eval_expr("len(recs)") == 3
    assert bytes(recs[0].k) == b"a" and bytes(memoryview(recs[1])) == b"b\x02" and str(recs[0].k) == "a" and recs[0].k == "a" and bool(top.size) and recs[0] == {"k": b"a", "n": 1}
    spec = Spec(b, "F")
    assert list(spec) == ["U", "Rec", "File"] and spec.Rec.members() == ["k", "n"] and spec["File"].members() == ["size", "recs"]
    with pytest.raises(KeyError):
        spec["None"]


def test_shell_verbs(tmp_path):
    import io

    from bytetree.__main__ import Shell

    (tmp_path / "s").write_text("let Pair = struct { a: byte <> integer { @signed: false; }; b: byte; };")
    (tmp_path / "d").write_bytes(b"\x07x")
    out = io.StringIO()
    sh = Shell(stdout=out)

    def said(line):
        out.seek(0), out.truncate()
        sh.onecmd(line)
        return out.getvalue().strip()

    assert said(f"import S spec {tmp_path}/s") == "" and said(f"import d {tmp_path}/d") == "" and said("list") == "S\nd"
    assert said("print (d <> S.Pair).a") == "7" and said("let twice = (d <> S.Pair).a * 2") == "" and said("twice") == "14"
    assert said(f"bind p S.Pair {tmp_path}/d") == "" and said("list p") == "a\nb" and said("dump p.a + 1") == "8"
    assert said("unset twice") == "" and "ExprError" in said("twice") and said(f"use {tmp_path}/s") == "" and said("(d <> Pair).a") == "7" and "ExprError" in (said("use") or said("(d <> Pair).a"))
    assert said("set loglevel warning") == "" and "ValueError" in said("set loglevel loud") and said("clear d") == "" and said("clear") == "" and said("list") == "" and sh.onecmd("quit")
