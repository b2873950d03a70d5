"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Of every `w` neighbouring k-grams the one with the smallest hash is kept, in benchmark and corpus alike, so two texts that share
`k + w - 1` words share a kept k-gram inside that span. Kept corpus k-grams are joined with those of the benchmark, and each hit is
extended to the full windows around it, word by word, so the result is exact whatever the hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, cut, fresh, text_hash, text_slices, texts_of

WINDOW = 8
GRAM = 5
INDEX_BYTES = 8 << 20  #: of benchmark text indexed and shipped at a time (some 250 MB on the driver while it is made); a larger benchmark is worked through in blocks
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_TABLE).split()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; h holds a 64-bit hash for each word."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _kept(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of k-grams that are smallest in some run of w, ties all kept."""
    if len(g) < w:
        return np.arange(len(g)) if len(g) and w == 1 else np.empty(0, np.int64)
    low = g[: len(g) - w + 1].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + len(low)], out=low)
    keep = np.zeros(len(g), bool)
    for j in range(w):
        keep[j : j + len(low)] |= g[j : j + len(low)] == low
    return np.flatnonzero(keep)


class Index:
    """Windows of a set of items, ready for `find`: arrays of a hash, the word numbers and the owners of each distinct window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.items = window, gram, sorted({i for i, _ in items})
        self.vocab: dict[bytes, int] = {}
        number = {x: i for i, x in enumerate(self.items)}
        by_size: dict[int, tuple[list, list]] = {}
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)], np.int32)
            if size := min(window, len(ids)):
                rows = np.lib.stride_tricks.sliding_window_view(ids, size)
                held = by_size.setdefault(size, ([], []))
                held[0].append(rows), held[1].append(np.full(len(rows), number[item], np.int32))
        rng = np.random.default_rng(7)
        self.hash = rng.integers(0, 1 << 63, len(self.vocab) + 1, dtype=np.uint64)
        self.sizes = {}
        for size, held in by_size.items():
            rows, owners = (np.concatenate(h) for h in held)
            k = min(gram, size) if size == window else size
            full = self._hash_rows(rows, size)
            order = np.lexsort((owners, full))
            rows, owners, full = rows[order], owners[order], full[order]
            prints = np.unique(np.concatenate([np.unique(self._hash_rows(rows[:, j : j + k], k)) for j in range(size - k + 1)]))
            new = np.r_[True, (full[1:] != full[:-1]) | (rows[1:] != rows[:-1]).any(1)] if len(rows) else np.empty(0, bool)
            starts = np.flatnonzero(new)
            self.sizes[size] = (k, prints, full[starts], rows[starts], owners, np.r_[starts, len(rows)])

    def _hash_rows(self, rows: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for j in range(k):
            out = (out ^ self.hash[rows[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def find(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each text: its number of words, the (start, size) pairs of its windows, the numbers of the items they are from."""
        get, ids, lens = self.vocab.get, [], []
        for t in texts:
            w = words_of(t)
            lens.append(len(w))
            ids += [get(x, -1) for x in w]
            ids.append(-1)  # no window crosses a text
        ids = np.array(ids, np.int32)
        known = ids >= 0
        starts = np.r_[0, np.cumsum(np.array(lens, np.int64) + 1)]
        h = self.hash[ids]
        at_all, size_all, row_all = [], [], []
        for size, (k, prints, full, rows, _, _) in self.sizes.items():
            if len(ids) < size:
                continue
            run = np.convolve(known, np.ones(k, np.int64), "valid") == k
            g = np.where(run, _grams(h, k), np.uint64(0xFFFFFFFFFFFFFFFF))
            at = _kept(g, size - k + 1)
            at = at[run[at]]
            where = np.minimum(np.searchsorted(prints, g[at]), len(prints) - 1)
            at = at[prints[where] == g[at]]
            at = np.unique((at[:, None] - np.arange(size - k + 1)).ravel())  # extend each hit to the windows that hold it
            at = at[(at >= 0) & (at <= len(ids) - size)]
            if not len(at):
                continue
            cells = ids[at[:, None] + np.arange(size)]
            inside = (cells >= 0).all(1)
            at, cells = at[inside], cells[inside]
            wide = self._hash_rows(cells, size)
            lo = np.searchsorted(full, wide, "left")
            for step in range(int((np.searchsorted(full, wide, "right") - lo).max(initial=0))):
                row = np.minimum(lo + step, len(rows) - 1)
                same = (rows[row] == cells).all(1)
                at_all.append(at[same]), size_all.append(np.full(same.sum(), size)), row_all.append(row[same])
        none = np.empty(0, np.int64)
        at, size, row = (np.concatenate([none, *x]).astype(np.int64) for x in (at_all, size_all, row_all))
        doc = np.searchsorted(starts, at, "right") - 1
        order = np.argsort(doc, kind="stable")
        at, size, row, doc = at[order], size[order], row[order], doc[order]
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for i, n in enumerate(lens):
            a, b = cuts[i], cuts[i + 1]
            owners = [self.sizes[int(s)][4][self.sizes[int(s)][5][r] : self.sizes[int(s)][5][r + 1]] for s, r in zip(size[a:b], row[a:b], strict=True)]
            out.append((n, np.stack([at[a:b] - starts[i], size[a:b]], 1), np.unique(np.concatenate(owners)) if owners else np.empty(0, np.int32)))
        return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many blocks there are, at least one, and the items of each: INDEX_BYTES of text or so, dealt by a hash of id and text.

    A text that stands under several ids counts, and is dealt, once for each.
    """
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // INDEX_BYTES))
    parts = (rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) for b in range(n))
    return n, ([(r.i, r.t.encode()) for r in part.collect()] for part in parts)


def overlaps(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_col: str = "text", prefix: str = "bench", id_col: str = "doc_id",
) -> DataFrame:
    """df with three more columns: `<prefix>_words` long, `<prefix>_spans` array of (start, end) word ranges that windows
    cover, merged and in order, and `<prefix>_items`, the sorted distinct ids, as strings, of the items those windows are from.

    A window is eight consecutive words of an item; an item of fewer words, but not none, is one window. Null and wordless
    texts have no words and no spans; repeated rows are each marked; repeated item ids count once; a null item id counts as
    the empty string; an empty benchmark marks nothing; names that df already has get an underscore.

    The index of a block of the benchmark is broadcast. With one block the corpus is read once, in place, with no shuffle. More
    blocks read it once each, and of all blocks but the last only the rows with windows are written, as id and hash, words
    covered and items; they meet the texts in a join that adaptive execution can split. Texts are never rewritten.
    """
    marked = _marked(df, benchmark, id_col, text_col, item_col, bench_col, prefix)
    return marked.drop(marked.columns[-1])


_KINDS = ["bigint", "array<struct<start:bigint,end:bigint>>", "array<string>", "bigint"]


def _marked(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, bench_col: str, prefix: str) -> DataFrame:
    """`overlaps` with a fourth column: how many words the longest item of fewer than WINDOW words has that lies whole in the text."""
    spark = df.sparkSession
    names = [fresh(df, f"{prefix}_{x}") for x in ("words", "spans", "items", "whole")]
    n, parts = _blocks(benchmark, item_col, bench_col)
    hits = None
    for number, part in enumerate(parts, 1):
        index = spark.sparkContext.broadcast(Index(part))
        del part
        if number == n:
            break
        found = df.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"), *_empty(["words", "spans", "items", "whole"]))
        found = cut(found.mapInArrow(_marker(index, 2, 3), found.schema).filter("size(items) > 0").select("id", "h", "spans", "items", "whole"))
        index.destroy()  # the finds are written
        hits = found if hits is None else hits.union(found)
    if hits is None:
        out = df.select("*", *_empty(names))
    else:
        # equal rows have equal finds, so sets and maxima are those of one row; a document's blocks are few
        each = hits.groupBy("id", "h").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.max("whole").alias("whole"))
        met = by_text(df, cut(each), id_col, text_col, "left")
        got = dict(zip(("spans", "items", "whole"), met.columns[-3:], strict=True))
        out = met.select(*df.columns, F.lit(None).cast("bigint").alias(names[0]), *(F.col(got[k]).alias(x) for k, x in zip(got, names[1:], strict=True)))
    return out.mapInArrow(_marker(index, df.columns.index(text_col), len(df.columns)), out.schema)


def _empty(names: list[str]) -> list:
    return [F.lit(None).cast(k).alias(n) for n, k in zip(names, _KINDS, strict=True)]


def _marker(index, text_at: int, own: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, text_at):
                old = (b.column(own + k).to_pylist() for k in (1, 2, 3))
                n, spans, items, whole = [], [], [], []
                for (words, found, owners), s, i, most in zip(index.value.find(texts_of(b.column(text_at).cast(pa.string()))), *old, strict=True):
                    n.append(words)
                    spans.append([{"start": a, "end": e} for a, e in _union([(int(a), int(a + k)) for a, k in found] + [(x["start"], x["end"]) for x in s or ()])])
                    items.append(sorted({index.value.items[o] for o in owners} | set(i or ())))
                    whole.append(int(max(most or 0, found[found[:, 1] < WINDOW, 1].max(initial=0))))
                cols = [b.column(c) for c in range(own)]
                made = [pa.array(x, b.schema.field(own + k).type) for k, x in enumerate((n, spans, items, whole))]
                yield pa.RecordBatch.from_arrays([*cols, *made], schema=b.schema)

    return run


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(
    df: DataFrame, benchmark: DataFrame, min_items: int = 1, least_words: int = WINDOW, text_col: str = "text", least_item: int = GRAM, id_col: str = "doc_id",
) -> DataFrame:
    """df without the rows that share windows with at least `min_items` items, if the windows cover `least_words` words or the
    whole text, or if an item of fewer than WINDOW words but at least `least_item` lies whole in the text.

    So an item shorter than that, which common prose may hold by chance, costs no longer text its place. Rows without words stay;
    nulls, repeats and empty tables as in `overlaps`.
    """
    marked = _marked(df, benchmark, id_col, text_col, "item_id", "text", "bench")
    words, spans, items, whole = marked.columns[-4:]
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    covered = hit >= F.least(F.lit(least_words).cast("long"), F.col(words))
    bad = (F.size(items) >= min_items) & (covered | (F.col(whole) >= least_item))
    return marked.filter(~bad).select(*df.columns)
