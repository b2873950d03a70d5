"""Token counts of flat, unindexed token files by a vectorised search for the end-of-document identifier.

A token file is nothing but little-endian token ids, each document followed by the separator id. It is searched in runs of bytes,
in as many tasks as it has byte ranges; a document that crosses runs or ranges is stitched together by a prefix scan over a few
numbers for each run.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_slices
from .rawfiles import write_raw

FILE_BYTES = 16 << 20
WIDTHS = {2: "<u2", 4: "<u4"}
# Fixed value: the public pre-tokenisation pattern that goes with the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file (lines of base64 token and rank), read on the driver and broadcast: at most a few MB."""
    with open(path, "rb") as f:
        return f.read()


def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(df: DataFrame, path: str, vocabulary: bytes, eod: int, text_col: str = "text", width: int = 2) -> None:
    """Write the tokens of each row's whole text, then eod, to flat files of `width` bytes an id in the folder `path`.

    Null and empty texts are documents of no tokens; repeated rows are each written; an empty table writes none; other columns
    are ignored, whatever their names. A ValueError if eod is an id of the vocabulary or if ids don't fit the width.
    """
    ranks = {int(line.split()[1]) for line in vocabulary.splitlines() if line}
    if eod in ranks or max(eod, *ranks) >= 1 << 8 * width:
        raise ValueError("eod must be outside of the vocabulary, and all ids must fit the width")
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)
    kind = WIDTHS[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shipped.value).encode_ordinary
        for batch in batches:
            for b in text_slices(batch, 0):
                raw = [np.array(encode(t or ""), dtype=kind).tobytes() for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    size = df.agg(F.avg(F.coalesce(F.octet_length(text_col), F.lit(0)))).first()[0] or 0
    tokens = df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "raw binary")
    write_raw(tokens, "raw", path, np.array([eod], kind).tobytes(), max(1, int(FILE_BYTES / (size * width / 3 + width))))


def find_ends(raw: np.ndarray, eod: int, width: int) -> np.ndarray:
    """Positions after each occurrence of the identifier's bytes, at any alignment."""
    mark = np.array([eod], WIDTHS[width]).view(np.uint8)
    n = len(raw) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = raw[:n] == mark[0]
    for k in range(1, width):
        hit &= raw[k : n + k] == mark[k]
    return np.flatnonzero(hit) + width


def whole(pieces: pa.Array, edge: int) -> np.ndarray:
    """The bytes of a run of pieces, each with the byte that ended it."""
    pieces = pieces.cast(pa.large_binary())
    ends = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
    out = np.full(int(ends[-1] - ends[0]) + len(pieces), edge, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends[1:] - ends[0] + np.arange(len(pieces))] = False
    out[inside] = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return out


def count_tokens(spark: SparkSession, path: str, eod: int, width: int = 2) -> DataFrame:
    """(file, doc, start, n_tokens): one row for each document of the token files in the folder `path`.

    file: the part file's number and chunk, or the file's name; doc: 0, 1, ... in the file; start: position of its first token;
    n_tokens: without the separator. Neighbouring separators enclose a document of no tokens; tokens after the last
    separator are a document; an empty file has none. Null documents can't be told from empty ones: a flat file holds tokens
    only. A file that doesn't hold whole ids is an error.

    Files split: a reader that can begin anywhere hands out byte ranges, cut at one byte of the identifier, so a file of any
    size is many tasks. Each run of bytes is searched for the identifier at once, at every alignment. A prefix scan over a
    few numbers for each run tells where it begins, and with that which occurrences are aligned, how many documents end before it
    and where the last one did; a document that crosses runs is stitched together from these.
    """
    edge = next((b for b in reversed(eod.to_bytes(width, "little")) if b), 0)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    part, chunk = F.regexp_extract(name, r"^part-(\d+)-", 1), F.regexp_extract(name, r"-(c\d+)\.", 1)
    lines = spark.read.format("text").option("lineSep", chr(edge)).option("encoding", "ISO-8859-1").option("pathGlobFilter", "[!_.]*").load(path)
    lines = lines.select(
        F.xxhash64("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"),
        F.when(part != "", F.concat_ws("-", part, chunk)).otherwise(name).alias("file"), F.col("value").cast("binary").alias("v"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            key, at = (batch.column(i).to_numpy() for i in (0, 1))
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1])]) if len(key) else np.empty(0, np.int64)
            for a, b in zip(new, [*new[1:], len(key)], strict=True):
                raw = whole(batch.column(4).slice(a, b - a), edge)
                ends = find_ends(raw, eod, width)
                inner, row = ends[ends < len(raw)], batch.slice(a, 1)
                by = [inner[inner % width == r] for r in range(width)]
                cols = [
                    *row.columns[:4], pa.array([number]), pa.array([len(raw)]), pa.array([inner], pa.list_(pa.int64())), pa.array([len(inner) < len(ends)]),
                    pa.array([[len(x) for x in by]], pa.list_(pa.int64())), pa.array([[int(x[-1]) if len(x) else 0 for x in by]], pa.list_(pa.int64())),
                    pa.array([raw[: width - 1].tobytes()], pa.binary()), pa.array([raw[-(width - 1) :].tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _RUN.split(", ")])
                number += 1

    return _stitch(cut(lines.mapInArrow(run, _RUN)), eod.to_bytes(width, "little"))


_RUN = "key long, at long, size long, file string, run long, n long, ends array<long>, closed boolean, counts array<long>, lasts array<long>, head binary, tail binary"


def _stitch(runs: DataFrame, mark: bytes) -> DataFrame:
    """Documents from runs of bytes. ends: where the identifier ends inside a run, at any alignment, but at the run's own end,
    which `closed` tells; counts and lasts: of these by alignment. Only the few numbers are scanned; ends are joined to them."""
    w = len(mark)
    order = Window.partitionBy("key").orderBy("at", "run")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    few = runs.drop("ends").withColumn("base", F.coalesce(F.sum("n").over(before), zero))
    near = F.concat_ws("", F.collect_list(F.decode("tail", "ISO-8859-1")).over(order.rowsBetween(1 - w, -1)))
    few = few.withColumn("near", near).withColumn("final", F.lead("n").over(order).isNull())
    cross = zero  # how many bytes of an identifier that began in earlier runs this run completes
    for j in range(1, w):
        ahead, rest = mark[: w - j].decode("latin-1"), mark[w - j :].decode("latin-1")
        whole_ = (F.substring(F.decode("head", "ISO-8859-1"), 1, j) == rest) & F.col("near").endswith(ahead)
        cross = F.when(whole_ & ((F.col("base") + j) % w == 0), F.lit(j).cast("long")).otherwise(cross)
    few = few.withColumn("cross", cross).withColumn("r", F.pmod(-F.col("base"), F.lit(w)).cast("int"))
    # the reader ends each line alike, so a file's last byte may be one that isn't there
    few = few.withColumn("closed", F.col("closed") & ((F.col("base") + F.col("n")) % w == 0) & (F.col("base") + F.col("n") <= F.col("size")) & (F.col("cross") != F.col("n")))
    inner = F.get("counts", F.col("r"))
    docs = inner + (F.col("cross") > 0).cast("long") + F.col("closed").cast("long")
    last = F.when(F.col("closed"), F.col("base") + F.col("n")).when(inner > 0, F.col("base") + F.get("lasts", F.col("r"))).when(F.col("cross") > 0, F.col("base") + F.col("cross"))
    few = few.withColumn("docs", docs).withColumn("last", last)
    few = few.withColumn("done", F.coalesce(F.sum("docs").over(before), zero)).withColumn("open", F.coalesce(F.max("last").over(before), zero))
    odd = F.when(F.col("final") & (F.col("size") % w != 0), F.raise_error(F.lit("the file doesn't hold whole ids")).cast("long")).otherwise(F.col("size"))
    few = few.select("key", "at", "run", "base", "cross", "closed", "r", "done", "open", "n", "final", odd.alias("size"), F.coalesce("last", "open").alias("upto"))
    met = runs.select("key", "at", "run", "file", "ends").join(few, ["key", "at", "run"])
    one = lambda c, v: F.when(c, F.array(v)).otherwise(F.array().cast("array<long>"))
    own = F.expr(f"transform(filter(ends, e -> e % {w} = r), e -> e + base)")
    stops = F.concat(one(F.col("cross") > 0, F.col("base") + F.col("cross")), own, one(F.col("closed"), F.col("base") + F.col("n")))
    rest = one(F.col("final") & (F.col("upto") < F.col("size")), F.col("size") + w)
    met = met.withColumn("stops", F.concat(stops, rest))
    spans = F.expr(f"transform(stops, (s, i) -> struct(done + i as doc, if(i = 0, open, stops[i - 1]) div {w} as start, s div {w} - 1 as stop))")
    out = met.select("file", F.explode(spans).alias("d"))
    return out.select("file", F.col("d.doc").cast("long").alias("doc"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))
