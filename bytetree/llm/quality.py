"""Quality classifier with hierarchical empirical Bayes: what a document's text says is combined with what the other documents of
its host and path are like, and sites with few documents shrink toward the level above them.

Text evidence is a logistic fit on style measures and on the mean log-odds of the text's hashed words and word pairs, which a
naive Bayes table gives. A site's documents count by their label where they have one, else by what their text says, and a
document never counts for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, by_text, cut, text_hash, text_slices, word_hashes

SAMPLE_ROWS = 12_000  #: labelled rows, at most, that the document classifier is fitted on
BROADCAST_SITES = 100_000  #: a site table of up to this many rows is broadcast, a larger one is joined by a shuffle
PRIOR_STRENGTH = (1.0, 1e4)  #: bounds of a level's strength, in documents
SHIFT = 2.0  #: a site moves a document's log-odds by this much at most, so clear texts decide for themselves
BUCKETS = 1 << 16  #: of the naive Bayes table
FOLDS = 4  #: the table that scores a training row is made without the row's fold
FEATURES = ("symbols", "capitals", "marks", "digits", "word_length", "distinct", "repeats", "dup_lines", "long_words", "log_words")  # of the style; terms follow


def features_of(text: str) -> np.ndarray:
    """Style measures of a whole text, all near 0 to 1; zeros for a text without words."""
    out = np.zeros(len(FEATURES))
    w = text.split()
    if not w:
        return out
    low = text.lower().split()
    lines = [x for x in text.split("\n") if x.strip()]
    solid = "".join(w).encode()
    share = lambda drop: (len(solid) - len(solid.translate(None, drop))) / len(solid)
    out[0] = share(_SYMBOLS)
    out[1] = sum(map(str.isupper, w)) / len(w)
    out[2] = share(_MARKS)
    out[3] = share(b"0123456789")
    out[4] = min(len(solid) / len(w), 40) / 10
    out[5] = len(set(low)) / len(low) ** 0.8
    out[6] = sum(map(eq, low, low[1:])) / len(w)
    out[7] = (len(lines) - len(set(lines))) / len(lines)
    out[8] = sum(map(LONG.__lt__, map(len, w))) / len(w)
    out[9] = np.log(len(w)) / 10
    return out


LONG = 30  #: characters that a word may have before it counts as long
_SYMBOLS, _MARKS = b"#*$%&|<>{}[]\\^~=_@+", b"!?.,;:-\"'()"


_LOWER = bytes(32 if c <= 32 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of each text's buckets) by runs of texts: of all words, A-Z in lower case, and of the pairs of neighbours,
    text by text; a text of n words has 2n buckets, the last a pair with nothing."""
    for _, h, _, n in word_hashes([t.encode() for t in texts], _LOWER):
        after = np.r_[h[1:], np.uint64(0)] if len(h) else h
        after[(np.cumsum(n) - 1)[n > 0]] = 0
        pairs = (h * np.uint64(0x9E3779B97F4A7C15) ^ after) * np.uint64(0x94D049BB133111EB)
        yield (np.stack([h, pairs], 1).ravel() >> np.uint64(48)).astype(np.uint16), 2 * n


def odds_table(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each bucket: seen (2, BUCKETS) of the n (2) texts of either class hold it; rare buckets count less."""
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return (np.clip(odds, -4, 4) * (seen.sum(0) / (seen.sum(0) + 3))).astype(np.float32)


def _mean(table: np.ndarray, terms: np.ndarray) -> float:
    return float(table[terms].mean()) if len(terms) else 0.0


class Model:
    """Log-odds for good quality of a text, at even prior odds. table: of the buckets; weights: of the style, then of the table's mean."""

    def __init__(self, table: np.ndarray | None = None, weights: np.ndarray | None = None, bias: float = 0.0):
        self.table = np.zeros(BUCKETS, np.float32) if table is None else table
        self.weights, self.bias = np.zeros(len(FEATURES) + 1) if weights is None else weights, bias

    def logits(self, texts: list[str]) -> np.ndarray:
        means = [np.empty(0)]
        for t, n in terms_of(texts):
            means.append(np.bincount(np.repeat(np.arange(len(n)), n), self.table[t], len(n)) / np.maximum(n, 1))
        style = np.array([features_of(t) for t in texts]).reshape(-1, len(FEATURES))
        return style @ self.weights[:-1] + self.weights[-1] * np.concatenate(means) + self.bias


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, bias) of a ridge-penalised logistic regression by Newton steps, the classes weighed alike."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    each = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, pen = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (each * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(h, z.T @ (each * (y - p)) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, label): labelled ids in the order of a hash, `rows` at most. Of an id with several labels the largest counts."""
    found = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("label")).filter("lid is not null and label in (0, 1)")
    return found.groupBy("lid").agg(F.max("label").alias("label")).orderBy(F.xxhash64("lid"), "lid").limit(rows)


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of at most SAMPLE_ROWS labelled rows, in the order of a hash of the id. Of a repeated id the smallest text counts.

    Texts become numbers where they lie, and their buckets are counted and looked up there: the driver receives the counts of the
    folds and len(FEATURES) + 1 numbers a row, however long the texts are.
    """
    ids = F.broadcast(labelled_sample(labels, id_col, label_col))
    sample = df.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).cast("string").alias("t")).join(ids, "lid")
    sample = sample.groupBy("lid").agg(F.min("t").alias("t"), F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                style = pa.array([features_of(t) for t in texts], pa.list_(pa.float64()))
                found = pa.array([x.tobytes() for t, n in terms_of(texts) for x in np.split(t, np.cumsum(n)[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), style, found], ["lid", "label", "style", "terms"])

    made = cut(sample.mapInArrow(run, "lid long, label int, style array<double>, terms binary"))
    got = made.select("lid", "label").toArrow().sort_by("lid")
    lids, y = got["lid"].to_numpy(), got["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, FOLDS * BUCKETS), np.int32)
        for b in batches:
            for lid, label, t in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), strict=True):
                seen[label, _fold(lids, lid) * BUCKETS + np.unique(np.frombuffer(t.as_buffer(), np.uint16)).astype(np.int64)] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], ["cell", "bad", "good"])

    cells = made.select("lid", "label", "terms").mapInArrow(count, "cell int, bad int, good int").groupBy("cell")
    cells = cells.agg(F.sum("bad").cast("int").alias("bad"), F.sum("good").cast("int").alias("good")).toArrow()
    seen = np.zeros((2, FOLDS * BUCKETS), np.int32)
    seen[:, cells["cell"].to_numpy()] = cells["bad"].to_numpy(), cells["good"].to_numpy()
    seen = seen.reshape(2, FOLDS, BUCKETS)
    n = np.stack([np.bincount(np.arange(len(y))[y == label] % FOLDS, minlength=FOLDS) for label in (0, 1)])
    shipped = df.sparkSession.sparkContext.broadcast([odds_table(seen.sum(1) - seen[:, k], n.sum(1) - n[:, k]) for k in range(FOLDS)])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(b.column(0).to_numpy(), b.column(2), strict=True)
            means = [_mean(shipped.value[_fold(lids, lid)], np.frombuffer(t.as_buffer(), np.uint16)) for lid, t in each]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(means, pa.float64())], ["lid", "style", "mean"])

    got = made.select("lid", "style", "terms").mapInArrow(look_up, "lid long, style array<double>, mean double").toArrow().sort_by("lid")
    style = got["style"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    weights, bias = fit(np.c_[style, got["mean"].to_numpy()], y)
    return Model(odds_table(seen.sum(1), n.sum(1)), weights, bias)


def _fold(lids: np.ndarray, lid: int) -> int:
    """The fold of a training row, by its place among the sorted ids."""
    return int(np.searchsorted(lids, lid)) % FOLDS


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """(id, h, host, path, quality_evidence, host_posterior, path_posterior, quality_score): one row for each row of df.

    evidence: log-odds for good quality from the text alone, at even prior odds. host_posterior: the share of good documents
    among the host's others, shrunk toward that of all other documents by a strength that the spread between hosts gives
    (method of moments); path_posterior: the same for a path of the host, shrunk toward its host. A document counts in these
    shares as its label says, else by the probability from its text. score: the probability that joins the evidence with the
    log-odds of the path, which count for SHIFT at most to either side of even. h: `text_hash` of text, host and path.

    Null and empty texts have zero features; null hosts and paths are sites of their own; without labels of both classes the
    evidence is zero; of an id with several labels the largest counts, null ids have none; an empty table gives no rows;
    repeated rows are each scored, as different documents; other columns are ignored.

    Each text is read once and stays where it is read. Sites are found by grouped sums, combined map-side, and come back to the
    rows by a broadcast join while they are at most BROADCAST_SITES, else by a shuffle that adaptive execution can split.
    """
    shipped = df.sparkSession.sparkContext.broadcast(fit_quality(df, labels, id_col, text_col, label_col))
    host, path = F.col(host_col).cast("string"), F.col(path_col).cast("string")
    key = text_hash(F.col(text_col), F.col(host_col), F.col(path_col))
    src = df.select(F.col(id_col).cast("long").alias("id"), key.alias("h"), host.alias("host"), path.alias("path"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for b in text_slices(batch, 4):
                found = model.logits([t or "" for t in b.column(4).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found)], ["id", "h", "host", "path", "e"])

    rows = cut(src.mapInArrow(run, "id long, h long, host string, path string, e double"))
    known = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("label")).filter("lid is not null and label in (0, 1)")
    known = known.groupBy("lid").agg(F.max("label").alias("label"))
    known = F.broadcast(known) if labels.count() <= BROADCAST_KEYS else known
    counted = F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-F.col("e"))))
    rows = rows.join(known, F.col("id") == F.col("lid"), "left").select("id", "h", "host", "path", "e", counted.alias("g"))

    paths = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("g").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    outer, inner = _moments(hosts), _moments(paths)
    total, good = paths.agg(F.sum("n"), F.sum("s")).first()
    hosts = hosts.select(F.col("host").alias("hh"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("hh"))).select(F.col("host").alias("sh"), F.col("path").alias("sp"), "n", "s", "hn", "hs")
    if paths.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    met = rows.join(sites, F.col("host").eqNullSafe(F.col("sh")) & F.col("path").eqNullSafe(F.col("sp")), "left")
    mean = (F.lit(good or 0.0) - F.col("g")) / F.nullif(F.lit(total or 0) - 1, F.lit(0))
    met = met.withColumn("m", F.coalesce(mean, F.lit(0.5)))
    met = met.withColumn("hp", (F.col("hs") - F.col("g") + outer * F.col("m")) / (F.col("hn") - 1 + outer))
    met = met.withColumn("pp", (F.col("s") - F.col("g") + inner * F.col("hp")) / (F.col("n") - 1 + inner))
    lean = F.least(F.greatest(_logit(F.col("pp")), F.lit(-SHIFT)), F.lit(SHIFT))
    final = 1 / (1 + F.exp(-(F.col("e") + lean)))
    return met.select("id", "h", "host", "path", F.col("e").alias("quality_evidence"), F.col("hp").alias("host_posterior"), F.col("pp").alias("path_posterior"), final.alias("quality_score"))


def _moments(sites: DataFrame) -> float:
    """Strength of the beta prior over a level's sites: weighted spread between sites beyond that of sampling."""
    n, s, q, k = sites.agg(F.sum("n"), F.sum("s"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.count("*")).first()
    if not n:
        return PRIOR_STRENGTH[1]
    mean = min(max(s / n, 1e-6), 1 - 1e-6)
    within = mean * (1 - mean)
    between = (q - n * mean * mean - (k - 1) * within) / n
    return float(np.clip(within / between - 1, *PRIOR_STRENGTH)) if between > 0 else PRIOR_STRENGTH[1]


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of df whose score is at least `threshold`, with df's columns.

    Rows that repeat id, text, host and path go only if all of them score below it. Nulls, empty texts, repeats and empty
    tables as in `score`; extra columns come along, whatever their names. Only ids and hashes of rejected rows are joined with the texts.
    """
    scored = score(df, labels, id_col, text_col, host_col, path_col)
    bad = cut(scored.groupBy("id", "h").agg(F.max("quality_score").alias("best")).filter(F.col("best") < threshold).select("id", "h"))
    return by_text(df, bad, id_col, text_col, "left_anti", host_col, path_col)
