"""Schemas of common binary formats, written from the public documents named beside them, and which one a file name or media
type calls for."""

from __future__ import annotations

from pathlib import PurePosixPath

_LITTLE = """
let Le = integer { @signed: false; @endian: 'little'; };
let byte8 = byte <> Le;  let half = [2] byte <> Le;  let word = [4] byte <> Le;
"""
_BIG = """
let Be = integer { @signed: false; @endian: 'big'; };
let byte8 = byte <> Be;  let half = [2] byte <> Be;  let word = [4] byte <> Be;  let long = [8] byte <> Be;
"""

# RFC 1952, section 2.3: member names are those of the document. The compressed blocks end where the eight bytes of the trailer begin.
GZIP = """
let File = struct { members: [] Member; };
let Member = struct {
    fixed: struct { id1: byte8; id2: byte8; cm: byte8; flg: byte8; mtime: word; xfl: byte8; os: byte8; };
    let ?fhcrc = fixed.flg >> 1 & 1;  let ?fextra = fixed.flg >> 2 & 1;  let ?fname = fixed.flg >> 3 & 1;  let ?fcomment = fixed.flg >> 4 & 1;
    if (?fextra == 1) { extra: struct { xlen: half; subfields: [xlen] byte <> [] Subfield; }; }
    if (?fname == 1) { name: Latin; }
    if (?fcomment == 1) { comment: Latin; }
    if (?fhcrc == 1) { crc16: half; }
    blocks: deflate { @output_size: trailer.isize; };
    trailer: struct { crc32: word; isize: word; };
};
let Subfield = struct { si1: byte8; si2: byte8; len: half; data: [len] byte; };
let Latin = string { @boundary: '\\0'; };
"""

# The ustar interchange format of POSIX.1 (pax utility), one flat record a file: header members in the order and under the names
# of the standard's table, then the contents, filled up to a whole record of 512 bytes.
TAR = """
let Text = string { @boundary: '\\0'; };
let Digits = Text <> string { @boundary: ' '; } <> formatted_integer { @base: 8; @empty_value: 0; };
let File = struct { files: [] Entry; };
let Entry = struct {
    name: [100] byte <> Text;  mode: [8] byte <> Digits;  uid: [8] byte <> Digits;  gid: [8] byte <> Digits;
    size: [12] byte <> Digits;  mtime: [12] byte <> Digits;  chksum: [8] byte <> Digits;  typeflag: byte <> string;
    linkname: [100] byte <> Text;  magic: [6] byte <> Text;  version: [2] byte <> string;
    uname: [32] byte <> Text;  gname: [32] byte <> Text;  devmajor: [8] byte <> Digits;  devminor: [8] byte <> Digits;
    prefix: [155] byte <> Text;
    [12] byte;
    contents: [size] byte;
    [-size & 511] byte;
    @key: name;
};
"""

# The published description of the sorted string table: data blocks, an index block whose values are handles, a footer of 48 bytes.
# A block is followed by its kind of compression (0 none, 1 snappy) and a checksum. Rows of the index block have their handle
# spelt out, so `?rows` leads from an index row to the rows it stands for.
SORTED_TABLE = """
let File = struct {
    stored: [] byte;
    handles: [40] byte <> struct { meta_at: varint; meta_size: varint; index_at: varint; index_size: varint; unused: [] byte; };
    magic: [8] byte;
    let ?packed = (stored[handles.index_at + handles.index_size ..][..1] <> byte8) == 1;
    if (?packed) { let ?index = stored[handles.index_at ..][.. handles.index_size] <> snappy <> Index; }
    else { let ?index = stored[handles.index_at ..][.. handles.index_size] <> Index; }
    let Index = struct { rows: [] Pointer; restarts: [n_restarts] word; n_restarts: word; };
    let Pointer = struct {
        shared: varint; non_shared: varint; value_length: varint; key_delta: [non_shared] byte; at: varint; size: varint;
        let ?packed = (File::stored[at + size ..][..1] <> byte8) == 1;
        if (?packed) { let ?rows = File::stored[at ..][.. size] <> snappy <> Data; } else { let ?rows = File::stored[at ..][.. size] <> Data; }
    };
    let Data = struct { rows: [] Row; restarts: [n_restarts] word; n_restarts: word; };
    let Row = struct { shared: varint; non_shared: varint; value_length: varint; key_delta: [non_shared] byte; value: [value_length] byte; };
};
"""

# The published description of the block log: records in blocks of 32 KiB, the last one as long as it comes; a rest too short
# for a record's seven bytes is filled up.
BLOCK_LOG = """
let File = struct { blocks: [] Block; };
let Block = struct { @maxspan: 32768; fragments: [] Fragment; filler: [] byte; };
let Fragment = struct { @minspan: 7; checksum: word; length: half; type: byte8; data: [length] byte; };
"""

# ISO/IEC 14496-12: a box is its size, its type and what the type says. Sizes 0 (up to the end) and 1 (a long one follows) as
# in section 4.2; the versions of a full box differ in the width of times and durations.
_MP4_INNER = ("moov", "trak", "edts", "mdia", "minf", "dinf", "stbl", "mvex", "moof", "traf", "mfra", "udta")  # fixed values: boxes of boxes
MP4 = """
let Tag = [4] byte <> string;
let File = struct { boxes: [] Box; };
let Box = struct {
    size: word; type: Tag;
    if (size == 1) { largesize: long; }
    if (size == 1) { @span: largesize; } else if (size != 0) { @span: size; }
    @minspan: 8;
    @key: type;
    if (INNER) { boxes: [] Box; }
    else if (type == 'ftyp' || type == 'styp') { major_brand: Tag; minor_version: word; compatible_brands: [] Tag; }
    else if (type == 'mvhd') { full: Full; if (full.version == 1) { time: Long; } else { time: Short; } rate: word; volume: half; [10] byte; matrix: [9] word; [24] byte; next_track_id: word; }
    else if (type == 'tkhd') { full: Full; if (full.version == 1) { time: LongTrack; } else { time: ShortTrack; } [8] byte; layer: half; alternate_group: half; volume: half; [2] byte; matrix: [9] word; width: word; height: word; }
    else if (type == 'mdhd') { full: Full; if (full.version == 1) { time: Long; } else { time: Short; } language: half; [2] byte; }
    else if (type == 'hdlr') { full: Full; [4] byte; handler_type: Tag; [12] byte; name: string { @boundary: '\\0'; }; }
    else if (type == 'stsd' || type == 'dref') { full: Full; entry_count: word; entries: [entry_count] Box; }
    else if (type == 'stts') { full: Full; runs: struct { entry_count: word; list: [entry_count] struct { sample_count: word; sample_delta: word; }; }; }
    else if (type == 'ctts') { full: Full; runs: struct { entry_count: word; list: [entry_count] struct { sample_count: word; sample_offset: word; }; }; }
    else if (type == 'stsc') { full: Full; runs: struct { entry_count: word; list: [entry_count] struct { first_chunk: word; samples_per_chunk: word; sample_description_index: word; }; }; }
    else if (type == 'stsz') { full: Full; sample_size: word; sample_count: word; if (sample_size == 0) { entry_sizes: [sample_count] word; } }
    else if (type == 'stco') { full: Full; entry_count: word; chunk_offsets: [entry_count] word; }
    else if (type == 'co64') { full: Full; entry_count: word; chunk_offsets: [entry_count] long; }
    else if (type == 'stss') { full: Full; entry_count: word; sample_numbers: [entry_count] word; }
    else if (type == 'elst') { full: Full; entry_count: word; if (full.version == 1) { edits: [entry_count] struct { duration: long; media_time: long; rate: word; }; } else { edits: [entry_count] struct { duration: word; media_time: word; rate: word; }; } }
    else if (type == 'mfhd') { full: Full; sequence_number: word; }
    else if (type == 'trex') { full: Full; track_id: word; defaults: [4] word; }
    else { payload: [] byte; }
};
let Full = struct { version: byte8; flags: [3] byte; };
let Short = struct { creation: word; modification: word; timescale: word; duration: word; };
let Long = struct { creation: long; modification: long; timescale: word; duration: long; };
let ShortTrack = struct { creation: word; modification: word; track_id: word; [4] byte; duration: word; };
let LongTrack = struct { creation: long; modification: long; track_id: word; [4] byte; duration: long; };
""".replace("INNER", " || ".join(f"type == '{x}'" for x in _MP4_INNER))

# RFC 3533, section 6: a page's body is cut by its own table of lacing values.
OGG = """
let File = struct { pages: [] Page; };
let Page = struct {
    capture_pattern: [4] byte <> string; version: byte8; header_type: byte8;
    granule_position: [8] byte <> integer { @signed: true; @endian: 'little'; };
    serial_number: word; sequence_number: word; checksum: word;
    lacing: struct { page_segments: byte8; values: [page_segments] byte8; };
    body: [len(lacing.values)] Lace;
    let Lace = struct { @span: Page::lacing.values[index(Page::body, self)]; packet_data: [] byte; };
};
"""

# Key and value, each behind its length, after a byte of flags.
KEY_VALUE_LOG = """
let File = struct { log: [] Pair; };
let Pair = struct { flags: byte8; key: Sized; value: Sized; @key: key.text; };
let Sized = struct { length: word; text: [length] byte <> string; };
"""

WORD_LIST = "let File = [] Entry;  let Entry = struct { word: string { @boundary: '\\n'; }; @key: word; };"

#: name -> (schema text, the type of a whole file, extensions, media types)
FORMATS: dict[str, tuple[str, str, tuple[str, ...], tuple[str, ...]]] = {
    "gzip": (_LITTLE + GZIP, "File", (".gz", ".tgz"), ("application/gzip", "application/x-gzip")),
    "tar": (TAR, "File", (".tar",), ("application/x-tar",)),
    "sorted_table": (_LITTLE + SORTED_TABLE, "File", (".ldb", ".sst"), ()),
    "block_log": (_LITTLE + BLOCK_LOG, "File", (".log",), ()),
    "mp4": (_BIG + MP4, "File", (".mp4", ".m4a", ".mov"), ("video/mp4",)),
    "ogg": (_LITTLE + OGG, "File", (".ogg", ".oga", ".ogv"), ("application/ogg", "audio/ogg")),
    "key_value_log": (_BIG + KEY_VALUE_LOG, "File", (".kvlog",), ()),
    "word_list": (WORD_LIST, "File", (".dict", ".words"), ()),
}


def find_format(path: str | None = None, extension: str | None = None, mimetype: str | None = None) -> str | None:
    """Name of the format that a path, extension or media type calls for."""
    ext = (extension if extension is None or extension.startswith(".") else f".{extension}") or (PurePosixPath(path).suffix if path else None)
    for name, (_, _, extensions, types) in FORMATS.items():
        if ext and ext.lower() in extensions or mimetype and mimetype in types:
            return name
    return None


def schema_of(name: str) -> tuple[str, str]:
    """(schema text, type of a whole file)"""
    text, top, _, _ = FORMATS[name]
    return text, top
