"""Bytes from a readable notation: two-digit hex tokens and quoted text."""

import re


def blob(text: str) -> bytes:
    out = bytearray()
    for m in re.finditer(r"""#[^\n]*|"([^"]*)"|'([^']*)'|([0-9a-fA-F]{2})\b""", text):
        if m[3]:
            out.append(int(m[3], 16))
        elif m[0][0] != "#":
            out += (m[1] if m[1] is not None else m[2]).encode("latin-1")
    return bytes(out)
