"""Hex spellings of encoded values, as Columns: test inputs are packed with these, since the language itself only reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def u_be(c: Column, width: int) -> Column:
    """Big-endian two's complement of a long."""
    return F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * width, 2 * width)


def u_le(c: Column, width: int) -> Column:
    h = u_be(c, width)
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))))


def text(c: Column) -> Column:
    return F.hex(F.encode(c, "UTF-8"))


def padded(c: Column, width: int) -> Column:
    """Text filled up with NUL bytes."""
    return F.rpad(text(c), 2 * width, "0")


def varint(c: Column, groups: int = 5) -> Column:
    """Little-endian 7-bit groups of a value below 2**(7 * groups)."""
    c = c.cast("long")
    parts = [
        F.when((c >= F.lit(1 << 7 * k)) if k else F.lit(True), u_be(F.shiftright(c, 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.when(c >= F.lit(1 << 7 * (k + 1)), F.lit(128)).otherwise(F.lit(0))), 1)).otherwise("")
        for k in range(groups)
    ]
    return F.concat(*parts)


def blobs(df: DataFrame, key: Column, order: list[str], record: Column, name: str = "k") -> DataFrame:
    """(k, content): the records of each key end to end, in order."""
    rows = df.select(key.alias(name), *order, record.alias("__r"))
    packed = F.array_sort(F.collect_list(F.struct(*order, "__r")))
    return rows.groupBy(name).agg(F.unhex(F.array_join(F.transform(packed, lambda x: x["__r"]), "")).alias("content"))
