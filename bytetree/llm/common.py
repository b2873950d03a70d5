"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import keep_until_end, work_base, work_folder

#: Sub-batches handed to numpy hold about this many bytes of text (one longer text is a sub-batch of its own).
SLICE_BYTES = 2 << 20


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_base(spark))
        keep_until_end(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)


shared_path = work_folder  #: a new folder below the same place


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores added until no column of df is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


HASH_BYTES = 1 << 19  #: of text whose words are hashed at once (one longer text is hashed alone)
_POWERS = np.multiply.accumulate(np.full(1 << 10, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(texts: list[bytes], classes: bytes, prefix: int = 0) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of all words, by runs of texts: (which texts, 64-bit hash of each word, of its first `prefix` bytes, words of each text).

    classes: what each byte becomes; a space separates words. All words of a run are hashed together, as sums of their bytes
    times powers of a constant.
    """
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) < HASH_BYTES):
            held += len(texts[b]) + 1
            b += 1
        if held > HASH_BYTES:
            parts = [_hashed(x, prefix) for x in _pieces(texts[a].translate(classes))]
            whole, part = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            yield slice(a, b), whole, part, np.array([len(whole)])
        else:
            whole, part, starts = _hashed(b" ".join(texts[a:b]).translate(classes), prefix)
            begin = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])
            yield slice(a, b), whole, part, np.diff(np.searchsorted(starts, begin))
        a = b


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text, cut between words."""
    a = 0
    while len(text) - a > HASH_BYTES:
        z = text.rfind(b" ", a + 1, a + HASH_BYTES)
        z = z if z > 0 else text.find(b" ", a + HASH_BYTES)
        if z < 0:
            break
        yield text[a:z]
        a = z
    yield text[a:]


def _hashed(text: bytes, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its hash, its prefix's hash (none without a prefix), where it begins."""
    buf = np.frombuffer(b" " + text + b" ", np.uint8)
    word = buf != 32
    change = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    none = np.empty(0, np.uint64)
    if not len(starts):
        return none, none, starts
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(first, sizes)
    cells = (buf[word].astype(np.uint64) + np.uint64(1)) * _POWERS[at & 1023]
    part = _mixed(np.add.reduceat(np.where(at < prefix, cells, np.uint64(0)), first)) if prefix else none
    return _mixed(np.add.reduceat(cells, first)), part, starts - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch where its text column has gathered `limit` bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield batch.slice(int(a), int(b - a))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def crc32_of(col):
    """Unsigned CRC-32 of the UTF-8 bytes of a string column; null counts as empty."""
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


#: Key tables of up to this many rows are broadcast; larger ones are joined by a shuffle that adaptive execution can split.
BROADCAST_KEYS = 200_000


def by_text(df: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str, *more: str) -> DataFrame:
    """Join df with keys (id, h, ...; h as `text_hash`), materialised already, on id and hash; nulls match nulls."""
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    names = {k: fresh(df, f"key_{k}") for k in keys.columns}
    keys = keys.withColumnsRenamed(names)
    return df.join(keys, F.col(id_col).cast("long").eqNullSafe(F.col(names["id"])) & (text_hash(F.col(text_col), *map(F.col, more)) == F.col(names["h"])), how)


def text_hash(text, *more):
    """A hash of the text, a null like an empty one, and of `more` columns."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in more))
