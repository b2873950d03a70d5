"""Value decoders: bytes in, value out. No Spark here."""

from __future__ import annotations

import base64
import re
import zlib

from ..errors import DataError, ExprError, Unsupported

MOST_BASE64, MOST_INFLATED = 100 << 20, 1 << 30
_BASE64 = re.compile(rb"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?")
_NATIVE = __import__("sys").byteorder


def wrap(x: int) -> int:
    """The signed 64-bit integer with the same low bits."""
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def integer(data: bytes, signed: bool, endian: bytes | None) -> int:
    if len(data) not in (1, 2, 4, 8):
        raise Unsupported(f"an integer of {len(data)} bytes")
    if endian is None:
        if len(data) > 1:
            raise DataError("an integer of several bytes has no @endian")
        order = "big"
    elif endian in (b"big", b"little"):
        order = endian.decode()
    elif endian == b"native":
        order = _NATIVE
    else:
        raise DataError(f"no such @endian: {endian!r}")
    return wrap(int.from_bytes(data, order, signed=signed))


def varint_size(data, at: int, stop: int) -> int:
    for k in range(at, stop):
        if data[k] < 128:
            return k + 1 - at
    raise DataError("a varint without its last byte")


def varint(data: bytes, endian: bytes | None) -> int:
    groups = [b & 127 for b in data[: varint_size(data, 0, len(data))]]
    if endian in (None, b"little"):
        groups.reverse()
    elif endian != b"big" and endian != b"native":
        raise DataError(f"no such @endian: {endian!r}")
    x = 0
    for g in groups:
        x = x << 7 | g
    return wrap(x)


def formatted_integer(data: bytes, base: int = 10, signed: bool = True, empty: int | None = None) -> int:
    if not 2 <= base <= 36:
        raise ExprError(f"no such @base: {base}")
    if not data:
        if empty is None:
            raise DataError("an empty number")
        return empty
    at, sign = 0, 1
    while at < len(data) and data[at] in b"+-":
        if not signed:
            raise DataError("a sign in an unsigned number")
        sign = -sign if data[at] == 45 else sign
        at += 1
    digits = data[at:]
    if not digits:
        raise DataError("a number without digits")
    x = 0
    for c in digits:
        d = c - 48 if 48 <= c <= 57 else (c | 32) - 87 if 97 <= (c | 32) <= 122 else 99
        if d >= base:
            raise DataError(f"{chr(c)!r} is no digit of base {base}")
        x = x * base + d
    if not -(1 << 63) <= sign * x < 1 << 63:
        raise DataError("the number is out of range")
    return sign * x


def base64_decode(data: bytes) -> bytes:
    if len(data) % 4 or not _BASE64.fullmatch(data):
        raise DataError("malformed base64")
    if len(data) // 4 * 3 > MOST_BASE64:
        raise DataError("the base64 output is too large")
    return base64.b64decode(data)


def inflate(data: bytes, size: int) -> bytes:
    """A raw deflate stream that fills exactly `size` bytes; bytes after the stream are ignored."""
    if not 0 <= size <= MOST_INFLATED:
        raise DataError(f"an output of {size} bytes")
    z = zlib.decompressobj(-15)
    try:
        out = z.decompress(data, size + 1)
    except zlib.error as e:
        raise DataError(f"malformed deflate stream: {e}") from e
    if not z.eof and len(out) == size:
        out += z.decompress(z.unconsumed_tail, 1)
    if not z.eof or len(out) != size:
        raise DataError("the deflate stream doesn't fill its output")
    return out


def snappy_decode(data: bytes) -> bytes:
    """The raw block format: a varint length, then literals and copies."""
    n = varint_size(data, 0, min(len(data), 5))
    size = varint(data[:n], None)
    if size > MOST_INFLATED:
        raise DataError("the snappy output is too large")
    out, at = bytearray(), n
    try:
        while at < len(data):
            tag, kind = data[at] >> 2, data[at] & 3
            at += 1
            if kind == 0:
                if tag >= 60:
                    k = tag - 59
                    tag = int.from_bytes(data[at : at + k], "little")
                    at += k
                if at + tag + 1 > len(data):
                    raise DataError("a snappy literal ends early")
                out += data[at : at + tag + 1]
                at += tag + 1
                continue
            if kind == 1:
                length, offset = (tag & 7) + 4, (tag >> 3) << 8 | data[at]
                at += 1
            else:
                k = 2 if kind == 2 else 4
                length, offset = tag + 1, int.from_bytes(data[at : at + k], "little")
                at += k
            if not 0 < offset <= len(out):
                raise DataError("a snappy copy from outside")
            if len(out) + length > size:
                break
            start = len(out) - offset
            piece = out[start : start + min(length, offset)]
            out += (piece * (length // len(piece) + 1))[:length]
    except IndexError as e:
        raise DataError("the snappy stream ends early") from e
    if len(out) != size or at < len(data):
        raise DataError("the snappy stream doesn't fill its output")
    return bytes(out)
