"""Tokens of the schema and path language."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import ExprError

KEYWORDS = {"let", "if", "else", "extern", "sizeof", "self", "true", "false"}
MOST_TEXT = 1 << 20

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)+", re.S)
_TOKEN = re.compile(
    r"""(?P<name>[?@]?[A-Za-z_][A-Za-z0-9_]*)
      | (?P<number>0[xX][0-9a-fA-F]+ | [0-9]+)
      | (?P<string>"(?:[^"\\\n]|\\.)*" | '(?:[^'\\\n]|\\.)*')
      | (?P<op>\.\. | :: | <> | <= | >= | == | != | << | >> | \|\| | && | [-+*/%&|^~!<>=:;,.(){}\[\]])""",
    re.X | re.S,
)
_ESCAPE = re.compile(rb"\\(x[0-9a-fA-F]{0,2}|[0-7]{1,3}|.)", re.S)
_PLAIN = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"b": b"\b", b"f": b"\f"}


class Token(NamedTuple):
    kind: str  # name, keyword, number, string, op, end
    text: str
    value: object
    at: int


def _unescape(m: re.Match) -> bytes:
    e = m[1]
    if e[:1] == b"x":
        return bytes([int(e[1:] or b"0", 16)])
    if e[:1].isdigit() and e[:1] < b"8":
        return bytes([int(e, 8) & 255])
    return _PLAIN.get(e, e)


def tokenize(text: str) -> list[Token]:
    if len(text) > MOST_TEXT:
        raise ExprError("the text is longer than 1 MiB")
    out, at = [], 0
    while True:
        if m := _SPACE.match(text, at):
            at = m.end()
        if at >= len(text):
            return [*out, Token("end", "", None, at)]
        m = _TOKEN.match(text, at)
        if not m:
            raise ExprError(f"unexpected character {text[at]!r} in line {text.count(chr(10), 0, at) + 1}")
        kind, word, value = m.lastgroup, m[0], None
        if kind == "name" and word in KEYWORDS:
            kind = "keyword"
        elif kind == "number":
            if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
                raise ExprError(f"malformed number {text[at:m.end() + 1]!r}")
            if word[:2] in ("0x", "0X"):
                value = int(word, 16)
            elif word[0] == "0" and len(word) > 1:
                if not re.fullmatch("[0-7]+", word):
                    raise ExprError(f"malformed octal number {word!r}")
                value = int(word, 8)
            else:
                value = int(word)
            if value >= 1 << 63:
                raise ExprError(f"{word} is out of range")
        elif kind == "string":
            value = _ESCAPE.sub(_unescape, word[1:-1].encode("utf-8"))
        out.append(Token(kind, word, value, at))
        at = m.end()
