"""Secret scan with corpus-wide ownership: patterns propose candidates in every text, and how many owners and repositories
share a candidate's value tells a widely copied example from a credential that one owner left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_slices

# The base patterns and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "entropy")

_HEX = re.compile(r"[0-9a-f]{16,}")  # the same as HEX with its least length: a run is matched whole
_ENTROPY = re.compile(r"[A-Za-z0-9+/_-]{24,}")
MAX_OWNERS = 2  #: a value that more owners share is an example


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of the base patterns, leftmost and non-overlapping for each kind, in code points."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy_spans(text: str, base: list[tuple]) -> list[tuple[int, int, str, str]]:
    """Long mixed runs of digits, capitals and small letters outside the base spans: the candidates the method may add."""
    out, k, reach = [], 0, 0
    for m in _ENTROPY.finditer(text):
        while k < len(base) and base[k][0] < m.end():  # both come in order of their starts
            reach, k = max(reach, base[k][1]), k + 1
        s = m[0]
        if reach <= m.start() and any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s) and len(set(s)) >= 12:
            out.append((m.start(), m.end(), "entropy", s))
    return out


_SPANS = "array<struct<start:int,end:int,kind:int,value:long>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS) -> DataFrame:
    """(id, base, found): one row for each input row. base: the base spans; found: all spans, each with the number of distinct
    owners and repositories that hold the same value and `live`, whether at most max_owners owners do.

    base is an array of (start, end, kind), found one of (start, end, kind, owners, repos, live), in order of start, then kind;
    kind counts in KINDS. Offsets are code points, ends exclusive. Entropy candidates come into `found` only if live. A null
    text is empty; null owners or repositories count as one each; repeated rows each come back, but repeat no owner; an empty
    table gives no rows; other columns are ignored.

    Values are hashed before they leave their row. Distinct (value, owner, repository) rows and the counts over them combine
    map-side; a value that a third of all texts hold meets the candidates in a join that adaptive execution can split. Only
    rows with candidates take part, without their texts.
    """
    owner = F.xxhash64(F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")))
    repo = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in repo_cols))
    src = df.select(F.col(id_col).cast("long").alias("id"), owner.alias("owner"), repo.alias("repo"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.int64())]))
        for batch in batches:
            for b in text_slices(batch, 3):
                spans = []
                for t in b.column(3).to_pylist():
                    base = base_spans(t or "")
                    every = [*base, *entropy_spans(t or "", base)]
                    spans.append([{"start": s, "end": e, "kind": KINDS.index(k), "value": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)} for s, e, k, v in every])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(spans, kind)], ["id", "owner", "repo", "spans"])

    rows = cut(src.mapInArrow(run, f"id long, owner long, repo long, spans {_SPANS}").withColumn("row", F.monotonically_increasing_id()))
    each = rows.filter(F.size("spans") > 0).select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    shared = each.select("value", "owner", "repo").distinct().groupBy("value", "owner").agg(F.count("*").alias("r")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("r").alias("repos"))
    judged = each.join(shared, "value").withColumn("live", F.col("owners") <= max_owners).filter((F.col("kind") < 3) | F.col("live"))
    whole = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "live"))).alias("found"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["kind"] < 3), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return rows.join(whole, "row", "left").select("id", base.alias("base"), F.coalesce("found", F.array().cast(whole.schema["found"].dataType)).alias("found"))


def spell(spans):
    """Column form: kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
