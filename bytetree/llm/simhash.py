"""Near-duplicate search over 64-bit SimHash fingerprints with a vantage-point tree.

* `fingerprints` makes one fingerprint a row from hashed word shingles.
* `link_fingerprints` splits the distinct fingerprints by their Hamming distance to vantage points. The top of the tree is
  fitted on a bounded sample drawn by hash and shipped to the executors; every distinct fingerprint is filed in one leaf and
  also asks each leaf that the triangle bound can't rule out. A leaf with too many members gets a tree of its own. Leaves are
  searched exactly, in parallel, and a leaf that many ask is searched by as many tasks; bit flips or plain comparison
  are left for the leaves that no vantage point parts.
* `near_groups` adds the connected components.
* `similar_groups` is the form for a Jaccard threshold: what these links connect is compared by shingles, and files of smallest
  hashes add the pairs that lie beyond the tree's radius (see there).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, cut, text_hash, text_slices, texts_of
from .graph import components

SEED = 42
LEAF = 2048  #: fingerprints aimed at in a leaf of the distributed tree
MAX_DEPTH = 16  #: bounds a tree on the driver: at most 2**16 leaves
SAMPLE_PER_LEAF = 32  #: sampled fingerprints a leaf that a tree is fitted on
CANDIDATES = 12  #: vantage points tried for a split; that with the fewest fingerprints near its boundary is taken
HOT_LEAF = 1 << 16  #: members; a leaf with more gets a tree of its own
ROUTE_ROWS = 1 << 15  #: rows routed at once
PIECE_ROWS = 1 << 18  #: visitors that one task compares with a leaf's members
GRID = 1 << 13  #: side of the pieces in which a leaf that nothing parts is compared, at radii other than 2
SPLIT_SAMPLE = 4096  #: fingerprints, at most, that a vantage point is chosen by
FLIP_COST = 1300  #: comparisons that one fingerprint's flips cost
USEFUL = 0.85  #: a split is used if it leaves less than this share of the comparisons
BLOCK = 1 << 20  #: distances held at once
BRUTE = 1 << 22  #: members times visitors that are compared without a further split


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of `words` lower-cased words, repeats included; none for a text without words."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64)


def simhash(h: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp is the SimHash as a signed long. Null and wordless texts have fingerprint zero; null ids stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, 1):
                fp = np.array([simhash(shingle_hashes(t, words)) for t in texts_of(b.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- vantage-point tree
def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """Of some vantage points and all radii, those that leave the fewest comparisons; None if no radius parts the points.

    A side is compared with what lies inside it or within `radius` of its boundary.
    """
    best, n = None, len(points)
    for vp in points[np.linspace(0, n - 1, min(n, CANDIDATES)).astype(np.int64)]:
        upto = np.cumsum(np.bincount(_distance(points, vp), minlength=65 + radius))  # points at most so far away
        mu = np.flatnonzero((upto[:65] > 0) & (upto[:65] < n))
        if not len(mu):
            continue
        below = np.where(mu >= radius, upto[np.maximum(mu - radius, 0)], 0)
        work = upto[mu] * upto[mu + radius] + (n - upto[mu]) * (n - below)
        k = int(np.argmin(work))
        if best is None or work[k] < best[0]:
            best = work[k], vp, int(mu[k])
    return best and best[1:]


def fit_tree(sample: np.ndarray, depth: int, radius: int) -> list[tuple[int, int] | None]:
    """A complete tree as a heap: node -> (vantage point, radius), inside is child 2i+1, outside 2i+2; None ends a branch."""
    tree: list = [None] * ((1 << depth) - 1)
    todo = [(0, sample)]
    while todo:
        node, pts = todo.pop()
        if node >= len(tree) or len(pts) < 2 or (s := _split(pts[:SPLIT_SAMPLE], radius)) is None:
            continue
        tree[node] = (int(s[0]), s[1])
        inside = _distance(pts, s[0]) <= s[1]
        todo += [(2 * node + 1, pts[inside]), (2 * node + 2, pts[~inside])]
    return tree


def route(tree: list, fps: np.ndarray, radius: int, member: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaf each member is filed in, and the leaves that the triangle bound leaves open to each row.

    Of two leaves with members that must meet only the later is asked, so each pair is met once; rows that are no members
    here ask every leaf that is open to them.
    """
    member = np.ones(len(fps), bool) if member is None else member
    rows, leaves, homes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    todo = [(0, np.arange(len(fps)), member)]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node >= len(tree) or tree[node] is None:
            rows.append(at), leaves.append(np.full(len(at), node)), homes.append(home)
            continue
        d = _distance(fps[at], np.uint64(tree[node][0])).astype(np.int64)
        mu = tree[node][1]
        inside, near, far = d <= mu, d - radius <= mu, d + radius > mu
        todo += [(2 * node + 1, at[near], home[near] & inside[near]), (2 * node + 2, at[far], home[far] & ~inside[far])]
    row, leaf, home = np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)
    own = np.full(len(fps), -1)
    own[row[home]] = leaf[home]
    keep = leaf >= own[row]
    return row[keep], leaf[keep], home[keep]


# ---------------------------------------------------------------- links in memory
def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the edges a-b, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b = a[differ], b[differ]
        low = np.minimum(ra[differ], rb[differ])
        np.minimum.at(root, ra[differ], low)
        np.minimum.at(root, rb[differ], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped


class _Links:
    """Edges, folded to a star for each component whenever many have gathered."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.held = n, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a), self.b.append(b)
        self.held += len(a)
        if self.held > 4_000_000:
            root = self.roots()
            at = np.flatnonzero(root != np.arange(self.n))
            self.a, self.b, self.held = [at], [root[at]], 0

    def roots(self) -> np.ndarray:
        none = np.empty(0, np.int64)
        return local_roots(self.n, np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))


def _flips(points: np.ndarray, m: np.ndarray, q: np.ndarray, links: _Links) -> None:
    """Exact for radius 2: two fingerprints differ in at most two bits iff they share a value at one flip or none from both."""
    flips = [np.uint64(0), *(np.uint64(1 << k) for k in range(64))]
    keys = np.concatenate([points[m] ^ f for f in flips])
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], np.tile(m, 65)[order]
    same = keys[1:] == keys[:-1]
    links.add(who[1:][same], who[:-1][same])
    for f in flips:
        near = points[q] ^ f
        at = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
        hit = keys[at] == near
        links.add(q[hit], who[at[hit]])


def link_leaf(points: np.ndarray, members: np.ndarray, visitors: np.ndarray, radius: int, among: bool = True) -> np.ndarray:
    """Roots (indexes into points) of the links between members, unless not `among`, and between members and visitors, at most radius apart.

    Large sides are parted further by vantage points; where a part is so dense that no vantage point parts it, radius 2 is
    searched by bit flips and any other radius block by block. A task's memory is bounded by HOT_LEAF and PIECE_ROWS.
    """
    links = _Links(len(points))
    todo = [(members, np.concatenate([members, visitors]) if among else visitors)]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) * len(q) > BRUTE:
            if (s := _split(points[m[:: len(m) // SPLIT_SAMPLE + 1]], radius)) is not None:
                dm, dq = _distance(points[m], s[0]).astype(np.int64), _distance(points[q], s[0]).astype(np.int64)
                inside, near, far = dm <= s[1], dq - radius <= s[1], dq + radius > s[1]
                work = inside.sum() * near.sum() + (~inside).sum() * far.sum()
                if work < USEFUL * len(m) * len(q):
                    todo += [(m[inside], q[near]), (m[~inside], q[far])]
                    continue
            if radius == 2 and len(m) * len(q) > FLIP_COST * (len(m) + len(q)):
                _flips(points, m, q, links)
                continue
        step = max(1, BLOCK // len(q))
        for a in range(0, len(m), step):
            i, j = np.nonzero(_distance(points[m[a : a + step], None], points[q]) <= radius)
            differ = m[a + i] != q[j]
            links.add(m[a + i[differ]], q[j[differ]])
    return links.roots()


# ---------------------------------------------------------------- distributed search
@dataclass
class Search:
    edges: DataFrame  #: (u, v): what links connect, and nothing else, is connected by them
    leaves: int = 0  #: leaves that were searched
    routed: int = 0  #: rows sent to these
    dense: int = 0  #: leaves that no vantage point parts, left to bit flips or plain comparison
    dense_rows: int = 0  #: rows of these
    levels: int = 0  #: trees of trees


def _fit(rows: DataFrame, todo: dict[int, tuple[int, int]], radius: int, leaf: int, least: int) -> dict[int, tuple[int, list]]:
    """For each leaf to part: the number of its first new leaf, and its tree."""
    members = sum(m for m, _ in todo.values())
    share = min(1.0, (leaf << MAX_DEPTH) / max(members, 1))  # of the leaves wished for, as many as the driver may hold
    depth = {k: int(np.clip(np.ceil(np.log2(max(m * share / leaf, 1))), least, MAX_DEPTH)) for k, (m, _) in todo.items()}
    drawn = {}
    if any(depth.values()):
        part = int(min(1.0, sum(SAMPLE_PER_LEAF << d for d in depth.values()) / members) * (1 << 30))
        got = rows.filter("home").filter(F.xxhash64("fp").bitwiseAND(F.lit((1 << 30) - 1)) < part).select("leaf", "fp").toPandas()
        mixed = np.random.default_rng(SEED)  # a fixed order that has nothing to do with the values
        drawn = {int(k): mixed.permutation(np.sort(v.to_numpy(np.int64))).view(np.uint64) for k, v in got.groupby("leaf")["fp"]}
    out, first = {}, 0
    for k in sorted(todo):
        out[k] = first, fit_tree(drawn.get(k, np.empty(0, np.uint64)), depth[k], radius)
        first += 2 << depth[k]
    return out


def _part(rows: DataFrame, trees: dict[int, tuple[int, list]], radius: int) -> DataFrame:
    """(above, leaf, fp, home): rows (leaf, fp, home), dealt to the leaves of the tree of their leaf, now called above."""
    shipped = rows.sparkSession.sparkContext.broadcast(trees)
    names = ["above", "leaf", "fp", "home"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            above, f, home = (np.concatenate(c) for c in zip(*held, strict=True))
            for k in np.unique(above):
                at = np.flatnonzero(above == k)
                first, tree = shipped.value[int(k)]
                row, leaf, own = route(tree, f[at].view(np.uint64), radius, home[at])
                for a in range(0, len(row), BLOCK):
                    cut_ = slice(a, a + BLOCK)
                    cols = np.full(len(row[cut_]), k), leaf[cut_] + first, f[at[row[cut_]]], own[cut_]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += len(b)
            if n >= ROUTE_ROWS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return rows.select("leaf", "fp", "home").mapInArrow(send, "above long, leaf long, fp long, home boolean")


def _mark(rows: DataFrame, on: str, values: dict[int, int], name: str) -> DataFrame:
    """Those rows whose `on` is a key of values, and its value as `name`; the keys are leaves, which have a bound."""
    table = rows.sparkSession.createDataFrame(pd.DataFrame({on: np.array(list(values), np.int64), name: np.array(list(values.values()), np.int64)}))
    return rows.join(F.broadcast(table), on)


def _search_leaves(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of rows (leaf, fp, home, pieces): a leaf's members with each other and with its visitors, a piece of these a task."""
    of = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    pieces = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).otherwise(F.array(of))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f, home = pdf["fp"].to_numpy(), pdf["home"].to_numpy()
        root = link_leaf(f.view(np.uint64), np.flatnonzero(home), np.flatnonzero(~home), radius, among=pdf["piece"].iloc[0] == 0)
        at = np.flatnonzero(root != np.arange(len(f)))
        return pd.DataFrame({"u": f[at], "v": f[root[at]]})

    return rows.select("leaf", "fp", "home", F.explode(pieces).alias("piece")).groupBy("leaf", "piece").applyInPandas(one, "u long, v long")


def _search_dense(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of rows (leaf, fp, home, size) of leaves that no vantage point parts.

    At radius 2 rows meet where they share a value at one flip or none: at most 65 share one, however dense the leaf is. At any
    other radius a leaf is compared in squares of GRID rows a side, each a task: exact, at the cost of its square.
    """
    if radius == 2:
        keys = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)))
        flipped = rows.select("fp").distinct().select("fp", F.explode(keys).alias("key"))
        met = flipped.groupBy("key").agg(F.min("fp").alias("lo"), F.collect_set("fp").alias("all"))
        return met.select(F.explode("all").alias("u"), F.col("lo").alias("v"))
    side = F.ceil(F.col("size") / GRID).cast("long")
    mine, others = F.pmod(F.xxhash64("fp"), side), F.sequence(F.lit(0).cast("long"), side - 1)
    asks = rows.select("leaf", "fp", F.lit(False).alias("home"), mine.alias("j"), F.explode(others).alias("i"))
    held = rows.filter("home").select("leaf", "fp", "home", F.explode(others).alias("j"), mine.alias("i"))

    def square(pdf: pd.DataFrame) -> pd.DataFrame:
        f, home = pdf["fp"].to_numpy(), pdf["home"].to_numpy()
        root = link_leaf(f.view(np.uint64), np.flatnonzero(home), np.flatnonzero(~home), radius, among=False)
        at = np.flatnonzero(f != f[root])
        return pd.DataFrame({"u": f[at], "v": f[root[at]]})

    return asks.unionByName(held).groupBy("leaf", "i", "j").applyInPandas(square, "u long, v long")


def search_fingerprints(fps: DataFrame, radius: int = 2, leaf: int = LEAF) -> Search:
    """Links of at most `radius` bits between the distinct signed longs of column fp, and how they were searched.

    A leaf with over HOT_LEAF members gets a tree of its own, fitted on its own sample, unless that leaves USEFUL of its
    comparisons or more: such a leaf is dense. Routed rows are written once a level, in the checkpoint folder. Within a leaf only
    a star for each local component is returned, so a dense group never becomes all its pairs. The driver holds trees and
    counts for at most about 2**MAX_DEPTH leaves of a level, however large the input.
    """
    n = fps.count()
    rows, todo = fps.select(F.lit(0).cast("long").alias("leaf"), "fp", F.lit(True).alias("home")), {0: (n, n)}
    edges: list[DataFrame] = []
    out = Search(None)
    while todo:
        trees = _fit(rows, todo, radius, leaf, min(out.levels, 1))
        parted = cut(_part(rows, trees, radius))
        sizes = parted.groupBy("above", "leaf").agg(F.count_if("home").alias("members"), F.count("*").alias("asks")).collect()
        left = dict.fromkeys(todo, 0)
        for r in sizes:
            left[r.above] += r.members * r.asks
        dense = {k: a for k, (m, a) in todo.items() if out.levels and left[k] >= USEFUL * m * a}
        own = [r for r in sizes if r.above not in dense]
        todo = {r.leaf: (r.members, r.asks) for r in own if r.members > HOT_LEAF}
        cool = {r.leaf: -(-r.asks // PIECE_ROWS) for r in own if r.leaf not in todo and r.members}
        whole = not dense and not todo and max(cool.values(), default=1) == 1
        if cool:
            edges.append(_search_leaves(parted.withColumn("pieces", F.lit(1).cast("long")) if whole else _mark(parted, "leaf", cool, "pieces"), radius))
        if dense:
            edges.append(_search_dense(_mark(rows, "leaf", dense, "size"), radius))
        rows = _mark(parted.select("leaf", "fp", "home"), "leaf", dict.fromkeys(todo, 0), "hot").drop("hot") if todo else rows
        out.levels += 1
        out.leaves += len(cool)
        out.routed += sum(r.asks for r in own if r.leaf in cool)
        out.dense += len(dense)
        out.dense_rows += sum(dense.values())
    out.edges = reduce(DataFrame.union, edges) if edges else fps.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    return out


def link_fingerprints(fps: DataFrame, radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """Distinct signed longs in column fp -> edges (u, v) that connect exactly what links of at most `radius` bits connect."""
    return search_fingerprints(fps, radius, leaf).edges


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): one row for each input row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id that links of at most `radius` bits reach, the row's
    own id included. Equal texts share a fingerprint and so a component; empty, blank and null texts have fingerprint zero and
    link like any other; repeated rows each come back; a null id never is a component_id unless its whole component has none;
    an empty table gives no rows; other columns are ignored.
    """
    rows = cut(fingerprints(df, id_col, text_col, words))
    groups = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(link_fingerprints(groups.select("fp"), radius))
    groups = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = groups.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = groups.join(lows, "root").select("fp", "component_id")
    return rows.join(groups, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- wide radius
ANCHORS = 12
BINS = 1024  #: of a signature, one byte each
GROUP = 512  #: files up to this size are compared in one piece
PIECE = 4096  #: rows of a side in one piece of a larger file
BROADCAST_PIVOTS = 2048  #: pivots, of about a kilobyte each, up to which they are broadcast


def signature(h: np.ndarray) -> np.ndarray:
    """One permutation hashing (Li, Owen and Zhang, 2012): the range of the sorted distinct hashes is cut into BINS, and a byte
    of the smallest hash in each is kept; zero for an empty bin. A text of few shingles is kept nearly whole."""
    out = np.zeros(BINS, np.uint8)
    at = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(h) else np.empty(0, np.int64)
    out[at[first]] = h[first] % np.uint64(255) + np.uint64(1)
    return out


class _Sets:
    """Signatures and sizes of shingle sets, for estimates of their Jaccard similarity."""

    def __init__(self, sig: np.ndarray, n):
        self.sig, self.n = sig, np.asarray(n, np.int64)
        self.full = np.packbits(sig > 0, axis=1).view(np.uint64)

    def only(self, rows: np.ndarray) -> _Sets:
        out = object.__new__(_Sets)
        out.sig, out.full, out.n = self.sig[rows], self.full[rows], self.n[rows]
        return out

    def near(self, sig: np.ndarray, full: np.ndarray, n, similarity: float, among: slice | None = None) -> np.ndarray:
        """Which sets (of the rows `among`) are similar to the given one, or row by row to the given ones."""
        s, f, m = (self.sig, self.full, self.n) if among is None else (self.sig[among], self.full[among], self.n[among])
        both_empty = BINS - np.bitwise_count(f | full).sum(1, dtype=np.int64)
        same = np.count_nonzero(s == sig, axis=1) - both_empty
        return (same >= similarity * np.maximum(BINS - both_empty, 1)) & (np.minimum(m, n) >= similarity * np.maximum(m, n))


def link_file(sets: _Sets, similarity: float, members: np.ndarray | None = None, queries: np.ndarray | None = None) -> np.ndarray:
    """Roots of the links between similar sets: of all pairs, or of each query with each member.

    Of all pairs, those of two sets that are both similar to the first set need no look: they are linked through it. Members lie
    in the order of their sizes, and a query looks at those whose size allows the similarity.
    """
    rows = np.arange(len(sets.n))
    links = _Links(len(rows))
    if queries is None:
        members, at = rows, np.flatnonzero(sets.near(sets.sig[0], sets.full[0], sets.n[0], similarity))
        links.add(at, np.zeros(len(at), np.int64))
        queries = np.setdiff1d(rows[1:], at)
    members = members[np.argsort(sets.n[members], kind="stable")]
    held = sets.only(members)
    lo, hi = np.searchsorted(held.n, np.floor(similarity * sets.n[queries])), np.searchsorted(held.n, np.ceil(sets.n[queries] / similarity), "right")
    for q, a, b in zip(queries, lo, hi, strict=True):
        at = members[a:b][held.near(sets.sig[q], sets.full[q], sets.n[q], similarity, slice(a, b))]
        links.add(at, np.full(len(at), q))
    return links.roots()


def _sketches(df: DataFrame, words: int) -> DataFrame:
    """(id, h, k, n, sig, anchors, fp): k names the set of distinct shingles, n is its size, anchors are its ANCHORS smallest
    hashes; fp is the SimHash of all shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for b in text_slices(batch, 2):
                k, n, sig, anchors, fp = [], [], [], [], []
                for t in texts_of(b.column(2)):
                    every = shingle_hashes(t, words)
                    fp.append(simhash(every))
                    h = np.unique(every)
                    k.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)), n.append(len(h))
                    sig.append(signature(h).tobytes()), anchors.append(h[:ANCHORS].view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(anchors, pa.list_(pa.int64())), pa.array(np.array(fp, np.uint64).view(np.int64))], ["id", "h", "k", "n", "sig", "anchors", "fp"])

    return df.select("id", "h", "t").mapInArrow(run, "id long, h long, k long, n int, sig binary, anchors array<long>, fp long")


def _search(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows (file, k, n, sig, role) -> links (u, v). role 2: compared with all of its file; else 1, queries, with 0, members."""

    def one(file: np.ndarray, k: np.ndarray, n: np.ndarray, role: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        whole = role[0] == 2
        root = link_file(_Sets(sig, n), similarity, None if whole else np.flatnonzero(role == 0), None if whole else np.flatnonzero(role == 1))
        at = np.flatnonzero(k != k[root])
        return pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(k[root[at]])], ["u", "v"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # pieces of one file
        for b in batches:
            if not len(b):
                continue
            cols = [c.to_numpy() for c in b.columns[:4]] + [_signatures(b.column(4))]
            file = cols[0]
            starts = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
            for i, (a, z) in enumerate(zip(starts, [*starts[1:], len(file)], strict=True)):
                if held and (i or held[0][0][0] != file[0]):
                    yield one(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                held.append(tuple(c[a:z].copy() for c in cols))
        if held:
            yield one(*map(np.concatenate, zip(*held, strict=True)))

    return rows.select("file", "k", "n", "role", "sig").repartition("file").sortWithinPartitions("file").mapInArrow(files, "u long, v long")


def _signatures(column: pa.Array) -> np.ndarray:
    """A column of signatures as rows of bytes, without a copy."""
    column = column.cast(pa.binary())
    first = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0]
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * BINS, int(first)).reshape(-1, BINS)


def _large_files(filed: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Links (u, v) of the files over GROUP rows; None if there are none.

    Every row is compared with its file's pivot; rows similar to it are linked through it. Any other row is compared with the
    whole file, piece by piece, so two similar sets of a file are linked whatever their other anchors are.
    """
    pivots = sizes.filter(F.col("size") > GROUP).select("anchor", "size", F.col("pivot.k").alias("k")).join(sets.select("k", "n", "sig"), "k")
    pivots = cut(pivots.select("anchor", "size", F.col("k").alias("pk"), F.col("n").alias("pn"), F.col("sig").alias("psig")))
    if not (count := pivots.count()):
        return None
    pivots = F.broadcast(pivots) if count <= BROADCAST_PIVOTS else pivots

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), PIECE):
                b = whole.slice(a, PIECE)
                mine, pivot = (_Sets(_signatures(b.column(f"{x}sig")), b.column(f"{x}n").to_numpy()) for x in ("", "p"))
                near = mine.near(pivot.sig, pivot.full, pivot.n, similarity)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("anchor", "size", "k", "pk")), pa.array(near)], ["anchor", "size", "k", "pk", "near"])

    met = filed.join(pivots.select("anchor"), "anchor", "left_semi")
    judged = met.join(sets.select("k", "n", "sig"), "k").join(pivots, "anchor").select("anchor", "size", "k", "n", "sig", "pk", "pn", "psig")
    judged = cut(judged.mapInArrow(compare, "anchor long, size long, k long, pk long, near boolean"))
    links = judged.filter(F.col("near") & (F.col("k") != F.col("pk"))).select(F.col("k").alias("u"), F.col("pk").alias("v"))

    asked = judged.filter(~F.col("near"))
    asking = cut(asked.groupBy("anchor").agg(F.count("*").alias("asks")))
    if not asking.limit(1).count():
        return links
    side = lambda rows, seed, role, own, other: rows.select(
        "anchor", "k", F.lit(role).alias("role"), F.pmod(F.xxhash64("k", F.lit(seed)), _pieces(own)).alias(f"at_{role}"),
        F.explode(F.sequence(F.lit(0).cast("long"), _pieces(other) - 1)).alias(f"at_{1 - role}"),
    ).select("k", "role", F.xxhash64("anchor", "at_0", "at_1").alias("file"))
    both = judged.join(asking, "anchor"), asked.join(asking, "anchor")
    pieces = side(both[0], 1, 0, "size", "asks").union(side(both[1], 2, 1, "asks", "size"))
    return links.union(_search(pieces.join(sets.select("k", "n", "sig"), "k"), similarity))


def _pieces(rows: str):
    return F.ceil(F.col(rows) / PIECE).cast("long")


def _tree_files(rows: DataFrame, radius: int) -> DataFrame:
    """(anchor, k): the sets of rows (k, fp), filed under what links of at most `radius` bits connect their fingerprints to."""
    fps = cut(rows.select("fp").distinct())
    roots = components(link_fingerprints(fps, radius))
    met = rows.select("k", "fp").distinct().join(roots, F.col("fp") == F.col("node"), "left")
    return met.select(F.coalesce("root", "fp").alias("anchor"), "k").distinct()


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(id, h, kept, rows): one row for each distinct (id, text); kept marks one of each group of similar texts, rows counts repeats.

    Fingerprints of the shingles go through the vantage-point tree of `link_fingerprints`; the sets of a component make a file,
    and inside it the similarity decides. At a Jaccard similarity of 0.8 about ten of 64 bits differ, a radius at which no
    triangle bound of a Hamming metric rules out any shard (distances of unrelated texts stay within 32 +- 12). For the pairs
    beyond `radius` each distinct shingle set is also filed under its twelve smallest hashes - two texts of similarity 0.8 miss
    all of them with probability 0.2**12. Inside all files signatures of BINS bytes are compared. Their estimate is the exact
    similarity for texts of few shingles, but for bins that two hashes share, and has a standard error of 0.013 at 0.8 for long
    ones. Files with the same rows are compared once, files over GROUP rows as `_large_files` says.

    Texts with the same words are always one group. Empty, blank and null texts are one group. h: xxhash64 of the text.
    The kept row has the smallest (id, h), nulls last. An empty table gives no rows.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    rows = cut(_sketches(src, words))
    low = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("h"))).alias("low")
    sets = cut(rows.groupBy("k").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("anchors").alias("anchors"), low))
    filed = sets.select(F.explode("anchors").alias("anchor"), "k").union(cut(_tree_files(rows, radius)))
    pivot = F.min(F.struct(F.xxhash64("anchor", "k").alias("by"), F.col("k"))).alias("pivot")
    sizes = cut(filed.groupBy("anchor").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("k")).alias("who"), pivot).filter("size > 1"))
    small = sizes.filter(F.col("size") <= GROUP).groupBy("size", "who").agg(F.min("anchor").alias("anchor")).select("anchor")
    small = filed.join(small, "anchor").join(sets.select("k", "n", "sig"), "k")
    links = _search(small.select(F.col("anchor").alias("file"), "k", "n", "sig", F.lit(2).alias("role")), similarity)
    large = _large_files(filed, sizes, sets, similarity)
    roots = components(links if large is None else links.union(large))
    groups = sets.join(roots, sets["k"] == roots["node"], "left").select("k", "low", F.coalesce("root", "k").alias("root"))
    kept = groups.groupBy("root").agg(F.min("low").alias("best"))
    groups = groups.join(kept, "root").select("k", "best")
    out = rows.join(groups, "k").groupBy("id", "h").agg(F.max((F.col("id").eqNullSafe(F.col("best.id"))) & (F.col("h") == F.col("best.h"))).alias("kept"), F.count("*").alias("rows"))
    return out


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """df with one row of each group of `similar_groups`, repeated rows dropped too. Texts are shuffled only where the dropped
    keys are too many to broadcast, or where a kept row repeats."""
    groups = cut(similar_groups(df, id_col, text_col, words, similarity))
    kept = by_text(df, groups.filter("not kept").select("id", "h"), id_col, text_col, "left_anti")
    if groups.filter("kept and rows > 1").limit(1).count():
        from .common import fresh

        h = fresh(df, "text_hash")
        kept = kept.withColumn(h, text_hash(F.col(text_col))).dropDuplicates([id_col, h]).drop(h)
    return kept
