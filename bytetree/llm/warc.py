"""WARC archives: write one transaction (request, response or revisit, metadata) for each page, read archives back, and
assemble the records of a transaction into one nested row by their concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_slices
from .rawfiles import read_raw, write_raw

FILE_BYTES = 48 << 20  #: of record bytes, before compression, aimed at in an archive
BROADCAST_ROWS = 100_000  #: repeated payloads (a digest and an id each) up to this number are broadcast, more are shuffled
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, warc_date string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def transaction(page_id: int | None, url: str | None, payload: bytes, salt: int, refers_to: int | None, refers_url: str | None = None) -> list[bytes]:
    """The records of one capture. A capture with refers_to is a revisit of the capture of refers_url: its block has the HTTP head without the payload."""
    digest = digest_of(payload)
    rid, ask, meta = (str(uuid.uuid5(uuid.NAMESPACE_URL, f"{k}|{page_id}|{digest}|{salt}")) for k in ("response", "request", "metadata"))
    uri = _uri(url)
    at = [("WARC-Target-URI", uri)] if uri else []
    with_it = [("WARC-Concurrent-To", f"<urn:uuid:{rid}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    sent = [*at, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    host, _, rest = uri.partition("://")[2].partition("/")
    fields = [("page-id", page_id), ("refers-to-page", refers_to)]
    if refers_to is None:
        capture = _record("response", rid, sent, http + payload)
    else:
        of = [("WARC-Refers-To-Target-URI", _uri(refers_url)), ("WARC-Refers-To-Date", DATE)] if refers_url else [("WARC-Refers-To-Date", DATE)]
        capture = _record("revisit", rid, [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *of, *sent], http)
    return [
        _record("request", ask, [*with_it, *at, ("Content-Type", "application/http;msgtype=request")], f"GET /{rest} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()),
        capture,
        _record("metadata", meta, [*with_it, *at, ("Content-Type", "application/warc-fields")], "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()),
    ]


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0) -> None:
    """Write df to gzip-compressed archives, a member for each record, in the folder `path`.

    Of rows whose payloads are equal and hold at least `revisit_bytes` bytes, that with the largest id is a response and the
    others are revisits that name its address and date; shorter ones are all responses. A null payload is an empty one. Rows that repeat the largest id are
    all responses, and so are rows of a payload that has null ids only; a null id beside others is a revisit. A null url
    leaves out the target. An empty table writes no record.

    Only digests and ids are shuffled to find repeats; pages themselves are shuffled only if the repeated payloads outnumber
    BROADCAST_ROWS, and adaptive execution can split that join at a payload that fills a third of the table.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    sizes = rows.filter(F.length("payload") >= revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("top"), F.max_by("url", "id").alias("top_url"))
    repeats = cut(sizes.filter("n > 1").select("digest", "top", "top_url"))
    if repeats.count() <= BROADCAST_ROWS:
        repeats = F.broadcast(repeats)
    rows = rows.join(repeats, "digest", "left")
    later = F.when(F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), F.col("top"))
    rows = rows.select("id", "url", "payload", later.alias("refers_to"), "top_url", F.monotonically_increasing_id().alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, 2):
                out = [b"".join(map(_gzip, transaction(i, u, p, s, r, o))) for i, u, p, r, o, s in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["raw"])

    size = df.agg(F.avg(F.coalesce(F.octet_length(payload_col), F.lit(0)))).first()[0] or 0
    write_raw(rows.mapInArrow(run, "raw binary"), "raw", path, _gzip(b""), max(1, int(FILE_BYTES / (size + 1500))))


def _members(data: memoryview) -> Iterator[bytes]:
    """Decompressed pieces of a file of gzip members, or the file itself if it isn't compressed."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield bytes(data)
        return
    at, z = 0, zlib.decompressobj(31)
    while at < len(data):
        piece = data[at : at + 16384]
        yield z.decompress(piece)
        at += len(piece) - len(z.unused_data)
        if z.eof:
            z = zlib.decompressobj(31)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive; a ValueError for what isn't one."""
    held = bytearray()
    pieces = _members(memoryview(data))
    done = False
    while not done:
        piece = next(pieces, None)
        done = piece is None
        held += piece or b""
        while True:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            lines = held[:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(headers.get("content-length", 0))
            if len(held) < end + 8 + size:
                break
            yield headers, bytes(held[end + 4 : end + 4 + size])
            del held[: end + 8 + size]
    if held.strip():
        raise ValueError("the archive ends within a record")


def _fields(block: bytes) -> list[tuple[str, str]]:
    return [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()]


_TEXT = ("record_id", "record_type", "concurrent_to", "target_uri", "warc_date", "payload_digest")
_ARROW = pa.schema([*((k, pa.string()) for k in _TEXT), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _row(h: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(_fields(block if kind == "metadata" else head.partition(b"\r\n")[2]))
    size = len(body) if kind == "response" else int(fields.get("content-length", 0)) if kind == "revisit" else None
    if kind == "response" and digest is not None and digest_of(body) != digest:
        raise ValueError(f"the payload digest of {h.get('warc-record-id')} differs")
    own = (h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), digest)
    return dict(zip(_TEXT, own, strict=True)) | {"payload_bytes": size, "fields": list(fields.items()), "payload": body if payloads and kind == "response" else None}


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives in the folder `path` (columns: RECORD).

    payload: of a response, the HTTP body (its digest is checked against the record's); null for other records, and for all
    with payloads=False. payload_bytes: length of the full payload, of a revisit the length its HTTP head states.
    fields: the HTTP head, or the lines of a metadata record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                rows, held = [], 0
                for headers, block in records(data.as_py()):
                    rows.append(_row(headers, block, payloads))
                    held += len(rows[-1]["payload"] or b"")
                    if len(rows) >= 2000 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return read_raw(spark, path).mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, capture, request, metadata).

    A record belongs to the capture that its concurrent-to identifier names, or to its own. The three kinds meet in one
    shuffle on that identifier. A missing request or metadata record is null, a request or metadata record without a capture
    gives a row with a null capture, and of repeated records of a kind one stays; ids are unique, so groups are small.
    """
    parts = F.struct("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "payload_bytes", "fields", "payload")
    kind = lambda *k: F.first(F.when(F.col("record_type").isin(*k), parts), ignorenulls=True)
    key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    return found.groupBy(key).agg(kind("response", "revisit").alias("capture"), kind("request").alias("request"), kind("metadata").alias("metadata"))
