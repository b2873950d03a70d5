"""Toxicity scores from a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows for the word and for its first PREFIX bytes. Filters of several widths run over
the words of the whole text; each filter's largest response feeds a logistic output, whose threshold is calibrated for each
language. The language is told from the text's function words, so nothing but the text decides a score.

All labelled rows teach. The driver starts the net on a bounded part of them; where there are more, executors count the words of
all rows and train on all of them, a piece a time each, and after each round the net goes on from the mean of what the pieces
learned (iterative parameter mixing, McDonald et al., 2010). Thresholds come from all calibration rows.

Embeddings and filters are multiplied out after training, so scoring a word is a few table rows and additions.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, cut, text_slices, word_hashes
from .decontaminate import _TABLE

BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS, PREFIX = 12, 6, (1, 2, 3), 5
PARTS = 2
TRAINING_WORDS = 1 << 20  #: words, at most, of the rows that the driver starts the net on: 8 bytes each
PIECE_BYTES = 24 << 20  #: bytes of text, about, of the rows that an executor trains on at once
ROUNDS = 4  #: times that executors go through all training rows
SLICE = 1 << 10  #: buckets whose changes by all pieces are merged at once
LOGIT_BINS, LOGIT_MOST = 256, 32  #: thresholds are sought between logits in bins of 1/LOGIT_BINS, up to LOGIT_MOST to either side
STRETCH = 60_000  #: words scored at once
EPOCHS, RATE, BATCH = 6, 0.1, 64
FOLDS = 5  #: every fifth row of the training rows calibrates and is not trained on
BETA = 2.0  #: of the F measure that thresholds are calibrated by; chosen by cross-validation on rows that teach
LEAST_CASES = 20  #: a language with fewer positive or negative calibration rows takes the common threshold
# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the and of to in is that it for was on are as with his they at be this from have or by",
    "fr": "le la les de des du et un une dans que qui est pour sur au il elle avec ce pas plus",
    "de": "der die das und zu den von mit ist des sich im dem nicht ein eine auf auch es an als",
    "es": "el los las y que en un una por con no su para es se del al lo como su más",
}
_LANG = {w.encode(): i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split()}
_KNOWN, _WHOSE = next((h[o], np.array(list(_LANG.values()))[o]) for _, h, _, _ in word_hashes(list(_LANG), _TABLE) for o in [np.argsort(h)])
LANGS = len(FUNCTION_WORDS)


def pack(texts: list[str]) -> list[np.ndarray]:
    """Each text as hashed words: numbers whose 16-bit pieces are the buckets of the word and of its prefix; the top bits tell
    whose function word it is."""
    out = []
    for _, h, prefix, n in word_hashes([t.lower().encode() for t in texts], _TABLE, PREFIX):
        at = np.minimum(np.searchsorted(_KNOWN, h), len(_KNOWN) - 1)
        whose = np.where(_KNOWN[at] == h, _WHOSE[at] + 1, 0).astype(np.uint64)
        code = h >> np.uint64(48) | prefix >> np.uint64(48) << np.uint64(16) | whose << np.uint64(60)
        out += np.split(code, np.cumsum(n)[:-1])
    return out


def language(text: np.ndarray) -> int:
    """The language with most function words in a text that `pack` gave, the first of equals; LANGS for none."""
    votes = np.bincount((text >> np.uint64(60)).astype(np.int64), minlength=LANGS + 1)[1:]
    return int(votes.argmax()) if votes.any() else LANGS


def _parts(codes: np.ndarray) -> np.ndarray:
    """(words, PARTS) buckets."""
    return np.ascontiguousarray(codes, "<u8").view("<u2").reshape(-1, 4)[:, :PARTS].astype(np.int32)


@dataclass
class Net:
    emb: np.ndarray  # (BUCKETS, DIM)
    filters: dict[int, np.ndarray]  # width -> (width * DIM, FILTERS)
    bias: np.ndarray  # one for each filter of each width
    out: np.ndarray
    base: float
    shift: np.ndarray  # logit of the threshold for each language, and the common one
    gain: dict[str, np.ndarray] | None = None  # squared gradients so far, while it learns

    def learnt(self) -> dict[str, np.ndarray]:
        return {"bias": self.bias, "out": self.out, "base": np.array([self.base]), **{f"f{k}": f for k, f in self.filters.items()}}

    def tables(self) -> np.ndarray:
        """(BUCKETS, sum of width * FILTERS): each bucket's part in each filter at each place."""
        cols = [self.emb @ f.reshape(k, DIM, FILTERS)[j] for k, f in self.filters.items() for j in range(k)]
        return np.concatenate(cols, 1).astype(np.float32)


def _pool(table: np.ndarray, parts: np.ndarray, lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter over each text, and where it is; texts shorter than a filter are padded with nothing."""
    pooled = np.zeros((len(lens), len(WIDTHS) * FILTERS), np.float32)
    where = np.full(pooled.shape, -1, np.int64)
    if not len(parts):
        return pooled, where
    r = table[parts].sum(1)
    at = np.repeat(np.cumsum(lens), lens) - np.arange(len(parts))  # words left in the text, itself included
    full = np.flatnonzero(np.array(lens) > 0)
    starts = (np.cumsum(lens) - lens)[full]
    c = 0
    for i, k in enumerate(WIDTHS):
        s = r[:, c : c + FILTERS].copy()
        for j in range(1, k):
            part = r[j:, c + j * FILTERS : c + (j + 1) * FILTERS]
            s[: len(s) - j] += np.where((at[: len(s) - j] > j)[:, None], part, 0)
        c += k * FILTERS
        top = np.maximum.reduceat(s, starts)
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        pooled[full, cols] = top
        where_s = s == np.repeat(top, np.array(lens)[full], 0)
        for f in range(FILTERS):
            hit = np.flatnonzero(where_s[:, f])
            doc = np.searchsorted(starts, hit, "right") - 1
            where[full[doc[::-1]], i * FILTERS + f] = hit[::-1]
    return pooled, where


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _count(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """(2, BUCKETS): texts of either class that hold each bucket."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for d, label in zip(docs, y, strict=True):
        seen[int(label), np.unique(d)] += 1
    return seen


def _odds(seen: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Smoothed log-odds of each bucket; rare buckets count less."""
    odds = np.log((seen[1] + 0.5) / (pos + 1)) - np.log((seen[0] + 0.5) / (neg + 1))
    return np.clip(odds * (seen.sum(0) / (seen.sum(0) + 3)), -3, 3)


def _initial(odds: np.ndarray, pos: float, neg: float, rng: np.random.Generator) -> Net:
    """One embedding axis starts at each bucket's smoothed log-odds, so frequent cues need few steps."""
    emb = rng.normal(0, 0.05, (BUCKETS, DIM))
    emb[:, 0] = odds
    filters = {k: rng.normal(0, 0.1, (k * DIM, FILTERS)) for k in WIDTHS}
    for k, f in filters.items():
        f.reshape(k, DIM, FILTERS)[:, 0, :2] += 1.0 / k
    n = len(WIDTHS) * FILTERS
    net = Net(emb, filters, np.full(n, -1.0), rng.normal(0, 0.1, n), 0.0, np.zeros(LANGS + 1))
    net.out.reshape(len(WIDTHS), FILTERS)[:, :2] = 1.0
    net.base = float(np.log(pos / neg)) - 1.0
    return net


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Net:
    """Fit the net on whole texts, as `pack` gives them."""
    rng = np.random.default_rng(seed)
    docs = [_parts(t) for t in texts]
    y = np.asarray(labels, np.float64)
    pos, neg = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    net = _initial(_odds(_count(docs, y), pos, neg), pos, neg, rng)
    if y.sum() in (0, len(y)):
        net.out[:] = 0
        net.base = -3.0 if not y.sum() else 3.0
        return net
    _learn(net, docs, y, np.where(y > 0, 0.5 * len(y) / pos, 0.5 * len(y) / neg), EPOCHS, rng)
    return net


def _batches(order: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """BATCH texts each, fewer where they have over STRETCH words together; a longer text goes alone."""
    a = 0
    while a < len(order):
        b, held = a + 1, len(docs[order[a]])
        while b < len(order) and b - a < BATCH and held + len(docs[order[b]]) <= STRETCH:
            held += len(docs[order[b]])
            b += 1
        yield order[a:b]
        a = b


def _learn(net: Net, docs: list[np.ndarray], y: np.ndarray, weigh: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Go on training the net, in place. weigh: what an error of each text counts."""
    emb, filters = net.emb, net.filters
    if net.gain is None:
        net.gain = {k: np.full(v.shape, 1e-3) for k, v in {"emb": emb, **net.learnt()}.items()}
    gain = net.gain

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        gain[name] += grad * grad
        value -= RATE * grad / np.sqrt(gain[name])

    for _ in range(epochs):
        for at in _batches(rng.permutation(len(docs)), docs):
            used, back = np.unique(np.concatenate([docs[i] for i in at]), return_inverse=True)
            back = back.reshape(-1, PARTS)
            small = np.concatenate([emb[used] @ f.reshape(k, DIM, FILTERS)[j] for k, f in filters.items() for j in range(k)], 1)
            pooled, where = _pool_whole(small, back) if len(at) == 1 and len(back) > STRETCH else _pool(small, back, [len(docs[i]) for i in at])
            act = np.maximum(pooled + net.bias, 0)
            err = (_sigmoid(act @ net.out + net.base) - y[at]) * weigh[at] / len(at)
            live = ((pooled + net.bias) > 0) & (where >= 0)
            up = err[:, None] * net.out * live
            g_emb = np.zeros((len(used), DIM))
            ends = np.cumsum([len(docs[i]) for i in at])
            for i, k in enumerate(WIDTHS):
                f = filters[k].reshape(k, DIM, FILTERS)
                g_f = np.zeros_like(f)
                d, c = np.nonzero(up[:, i * FILTERS : (i + 1) * FILTERS])
                u, p0 = up[d, i * FILTERS + c], where[d, i * FILTERS + c]
                for j in range(k):
                    ok = p0 + j < ends[d]
                    p, cc, uu = p0[ok] + j, c[ok], u[ok]
                    np.add.at(g_f[j].T, cc, uu[:, None] * emb[used[back[p]]].sum(1))
                    for part in range(PARTS):
                        np.add.at(g_emb, back[p, part], uu[:, None] * f[j].T[cc])
                step(f"f{k}", filters[k], g_f.reshape(k * DIM, FILTERS) + 1e-5 * filters[k])
            gain["emb"][used] += g_emb * g_emb
            emb[used] -= RATE * g_emb / np.sqrt(gain["emb"][used])
            step("out", net.out, act.T @ err + 1e-5 * net.out)
            step("bias", net.bias, up.sum(0))
            base = np.array([net.base])
            step("base", base, np.array([err.sum()]))
            net.base = float(base[0])


class Scorer:
    def __init__(self, net: Net):
        self.net, self.table = net, net.tables()

    def logits(self, texts: list[np.ndarray], langs: list[int]) -> np.ndarray:
        """Logit of each text, as `pack` gives it, less the threshold of its language."""
        out = np.empty(len(texts))
        a = 0
        while a < len(texts):
            if len(texts[a]) > STRETCH:
                pooled = _pool_long(self.table, texts[a])
                out[a] = np.maximum(pooled + self.net.bias, 0) @ self.net.out + self.net.base
                a += 1
                continue
            b, held = a, 0
            while b < len(texts) and held < STRETCH and len(texts[b]) <= STRETCH:
                held += len(texts[b])
                b += 1
            pooled = _pool_max(self.table, _parts(np.concatenate(texts[a:b])), list(map(len, texts[a:b])))
            out[a:b] = np.maximum(pooled + self.net.bias, 0) @ self.net.out + self.net.base
            a = b
        return out - self.net.shift[langs] if len(texts) else out


def _pool_max(table: np.ndarray, parts: np.ndarray, lens: list[int]) -> np.ndarray:
    """_pool without the places."""
    pooled = np.zeros((len(lens), len(WIDTHS) * FILTERS), np.float32)
    if not len(parts):
        return pooled
    r = table[parts[:, 0]]
    for k in range(1, PARTS):
        r += table[parts[:, k]]
    size = np.array(lens)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(parts))
    full = np.flatnonzero(size > 0)
    starts = (np.cumsum(size) - size)[full]
    c = 0
    for i, k in enumerate(WIDTHS):
        s = r[:, c : c + FILTERS]
        for j in range(1, k):
            part = r[j:, c + j * FILTERS : c + (j + 1) * FILTERS] * (left[:-j] > j)[:, None]
            s[: len(s) - j] += part
        c += k * FILTERS
        pooled[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum.reduceat(s, starts)
    return pooled


def _pool_long(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """_pool_max of one long text."""
    return _pool_whole(table, _parts(codes))[0][0]


def _pool_whole(table: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_pool of one long text, by stretches of STRETCH words that see as far beyond their end as the widest filter does."""
    pooled = np.full((1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    where = np.full(pooled.shape, -1, np.int64)
    for a in range(0, len(parts), STRETCH):
        r = table[parts[a : a + STRETCH + max(WIDTHS) - 1]].sum(1)
        c = 0
        for i, k in enumerate(WIDTHS):
            s = r[:, c : c + FILTERS].copy()
            for j in range(1, k):
                s[: len(s) - j] += r[j:, c + j * FILTERS : c + (j + 1) * FILTERS]
            c += k * FILTERS
            first = s[:STRETCH].argmax(0)
            for f, p in enumerate(first):
                if s[p, f] > pooled[0, i * FILTERS + f]:
                    pooled[0, i * FILTERS + f], where[0, i * FILTERS + f] = s[p, f], a + p
    return pooled, where


def calibrate(net: Net, texts: list[np.ndarray], langs: list[int], labels: np.ndarray) -> None:
    """Set the thresholds: for all rows, and for each language with enough of both classes, midway in the widest best gap."""
    z = Scorer(net).logits(texts, langs)
    _set_thresholds(net, pd.DataFrame({"lang": langs, "bin": np.arange(len(z)), "n": 1, "hits": np.asarray(labels, np.int64), "low": z, "high": z}))


def _set_thresholds(net: Net, rows: pd.DataFrame) -> None:
    """Thresholds from bins of logits: n rows of a language, `hits` of them toxic, with logits from low to high."""
    together = rows.groupby("bin").agg({"n": "sum", "hits": "sum", "low": "min", "high": "max"})
    net.shift[:] = _threshold(together) if 0 < rows["hits"].sum() < rows["n"].sum() else 0.0
    for k in range(LANGS):
        own = rows[rows["lang"] == k]
        if min(own["hits"].sum(), (own["n"] - own["hits"]).sum()) >= LEAST_CASES:
            net.shift[k] = _threshold(own)


def _threshold(rows: pd.DataFrame) -> float:
    """The cut with the highest F measure, recall counting BETA times as much as precision, midway between the neighbouring logits."""
    n, hits, low, high = (rows[c].to_numpy() for c in ("n", "hits", "low", "high"))
    order = np.argsort(-high, kind="stable")
    n, hits, low, high = n[order], hits[order], low[order], high[order]
    k = int(np.argmax(np.cumsum(hits) / (np.cumsum(n) + BETA**2 * hits.sum())))
    return float((low[k] + high[k + 1]) / 2) if k + 1 < len(low) else float(low[k]) - 1e-3


def fit_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> Net:
    """Train on all labelled rows; every fifth, by a hash of the id, calibrates the thresholds and is not trained on.

    usable: a condition on the labels' id, so that other rows never teach. Texts become hashed words where they lie. Rows of at
    most TRAINING_WORDS words come to the driver, in the order of a hash of the id, and the net starts on them; if these are not
    all rows, `_train_all` and `_calibrate_all` go through all of them. Of a repeated id the smallest text and the largest label
    count; null ids and labels teach nothing; null and empty texts teach as texts without words. With labels of one kind, or
    none, every text scores alike.
    """
    known = labels if usable is None else labels.filter(usable)
    known = known.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("label")).filter("lid is not null and label in (0, 1)")
    known = cut(known.groupBy("lid").agg(F.max("label").alias("label")))  # an id with several labels takes the largest, as everywhere
    known = F.broadcast(known) if known.count() <= BROADCAST_KEYS else known
    got = df.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).cast("string").alias("t")).join(known, "lid")
    pieces = -(-(got.agg(F.sum(F.octet_length("t"))).first()[0] or 1) // PIECE_BYTES)
    got = got.withColumn("piece", F.pmod(F.xxhash64("lid"), F.lit(pieces)).cast("int")).repartition(4 * pieces, "piece")  # so that few pieces meet in a task
    got = got.groupBy("piece", "lid").agg(F.min("t").alias("t"), F.max("label").alias("label")).sortWithinPartitions("piece", "lid")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, 2):
                texts = pack([t or "" for t in b.column(2).to_pylist()])
                check = pa.array([zlib.crc32(b"c%d" % i) % FOLDS == 0 for i in b.column(1).to_pylist()], pa.bool_())
                cols = pa.array([_parts(t).astype("<u2").tobytes() for t in texts], pa.binary()), pa.array(map(language, texts), pa.int32()), check
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *cols], ["piece", "lid", "label", "words", "lang", "check"])

    made = cut(got.mapInArrow(packed, "piece int, lid long, label int, words binary, lang int, check boolean"))
    size = F.length("words") / (2 * PARTS)
    n, total = made.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    part = int(min(1.0, 1.1 * TRAINING_WORDS / max(total, 1)) * (1 << 30))
    first = made.filter(F.xxhash64("lid", F.lit(1)).bitwiseAND(F.lit((1 << 30) - 1)) < part)
    upto = F.sum(size).over(Window.orderBy(F.xxhash64("lid"), "lid"))  # over a bounded part
    rows = first.withColumn("upto", upto).filter(F.col("upto") <= TRAINING_WORDS).drop("upto").toArrow().sort_by("lid")
    texts, langs, y, check = _codes(rows["words"]), rows["lang"].to_pylist(), rows["label"].to_numpy().astype(np.int64), rows["check"].to_numpy().astype(bool)
    net = train([t for t, c in zip(texts, check, strict=True) if not c], y[~check])
    if len(y) < n:
        net = _train_all(made.filter("not check").select("piece", "label", "words"), net, texts, y, check)
        _calibrate_all(made.filter("check").select("label", "words", "lang"), net)
    else:
        held = np.flatnonzero(check)
        calibrate(net, [texts[i] for i in held], [langs[i] for i in held], y[held])
    net.gain = None
    return net


def _codes(words) -> list[np.ndarray]:
    """Texts as `pack` gives them, but for the bits that tell the language, from the buckets that `fit_toxicity` writes."""
    out = []
    for t in words:
        parts = np.frombuffer(t.as_buffer(), "<u2").reshape(-1, PARTS).astype(np.uint64)
        out.append(parts[:, 0] | parts[:, 1] << np.uint64(16))
    return out


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(piece, its texts as rows of buckets, its labels) of rows (piece, label, words) that come piece by piece."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[int, list[np.ndarray], np.ndarray]:
        docs = [np.frombuffer(t.as_buffer(), "<u2").reshape(-1, PARTS) for b in held for t in b.column(2)]
        return held[0].column(0)[0].as_py(), docs, np.concatenate([b.column(1).to_numpy() for b in held]).astype(np.float64)

    for batch in batches:
        at = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            if held and held[0].column(0)[0].as_py() != at[a]:
                yield whole()
                held = []
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield whole()


def _train_all(rows: DataFrame, net: Net, texts: list[np.ndarray], y: np.ndarray, check: np.ndarray, seed: int = 3) -> Net:
    """The net, started on some texts, trained on all rows (piece, label, words), ROUNDS times.

    The log-odds of the first axis become those of all rows. In a round each piece is learned from the same net; a bucket then
    moves by the mean of its changes in the pieces that hold it, all else by the mean of the pieces weighed by their rows. The
    driver receives one net a round, however many pieces there are.
    """
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS + 1), np.int64), 0
        for _, docs, labels in _by_piece(batches):
            seen[:, :-1] += _count(docs, labels)
            seen[:, -1] += np.array([(labels == 0).sum(), (labels == 1).sum()])
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bucket", "neg", "pos"])

    found = rows.mapInArrow(count, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow()
    seen = np.zeros((2, BUCKETS + 1))
    seen[:, found["bucket"].to_numpy()] = found["neg"].to_numpy(), found["pos"].to_numpy()
    neg, pos = seen[:, -1]
    if not neg or not pos:
        net.out[:], net.base = 0, 3.0 if pos else -3.0
        return net
    odds, own = _odds(seen[:, :-1], pos, neg), y[~check]
    if 0 < own.sum() < len(own):
        ours = _count([_parts(t) for t, c in zip(texts, check, strict=True) if not c], own)
        net.emb[:, 0] += odds - _odds(ours, own.sum(), (1 - own).sum())
    else:
        net = _initial(odds, pos, neg, np.random.default_rng(seed))
    for k in range(ROUNDS):
        if net.gain is None:
            _learn(net, [], np.empty(0), np.empty(0), 0, np.random.default_rng(seed))
        slim = Net(net.emb.astype(np.float32), net.filters, net.bias, net.out, net.base, net.shift, net.gain | {"emb": net.gain["emb"].astype(np.float32)})
        shipped = spark.sparkContext.broadcast(pickle.dumps(slim))
        changes = rows.mapInArrow(_teacher(shipped, pos, neg, (seed, k)), "slice int, piece int, n long, bucket binary, moved binary, gained binary")
        merged = changes.groupBy("slice").applyInArrow(_merge, "slice int, bucket binary, moved binary, gained binary").toArrow()
        for row in merged.to_pylist():
            moved, gained = (np.frombuffer(row[c], np.float32) for c in ("moved", "gained"))
            if row["slice"] >= 0:
                at = np.frombuffer(row["bucket"], np.uint16)
                net.emb[at] += moved.reshape(-1, DIM)
                net.gain["emb"][at] += gained.reshape(-1, DIM)
                continue
            a = 0
            for name, value in net.learnt().items():
                value += moved[a : a + value.size].reshape(value.shape)
                net.gain[name] += gained[a : a + value.size].reshape(value.shape)
                a += value.size
                if name == "base":
                    net.base = float(value[0])
        shipped.destroy()
    return net


def _teacher(shipped: Broadcast, pos: float, neg: float, seed: tuple[int, ...]):
    """Rows (piece, label, words) -> how each piece, gone through once, changes the shipped net: buckets by slices, slice -1 all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slice", "piece", "n", "bucket", "moved", "gained"]
        for piece, docs, y in _by_piece(batches):
            net = pickle.loads(shipped.value)
            net.emb, net.gain["emb"] = net.emb.astype(np.float64), net.gain["emb"].astype(np.float64)
            before = {"emb": net.emb.copy(), **{k: v.copy() for k, v in net.learnt().items()}}
            gained = {k: v.copy() for k, v in net.gain.items()}
            _learn(net, docs, y, np.where(y > 0, 0.5 * (pos + neg) / pos, 0.5 * (pos + neg) / neg), 1, np.random.default_rng([*seed, piece]))
            used = np.unique(np.concatenate([np.unique(d) for d in docs])).astype(np.int64)
            flat = lambda now, then: np.concatenate([(now[k] - then[k]).ravel() for k in net.learnt()]).astype(np.float32).tobytes()
            out = [(-1, piece, len(docs), b"", flat(net.learnt(), before), flat(net.gain, gained))]
            for at in np.split(used, np.flatnonzero(np.diff(used // SLICE)) + 1) if len(used) else []:
                moved, more = ((now[at] - then[at]).astype(np.float32).tobytes() for now, then in ((net.emb, before["emb"]), (net.gain["emb"], gained["emb"])))
                out.append((int(at[0]) // SLICE, piece, len(docs), at.astype(np.uint16).tobytes(), moved, more))
            types = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Mean changes of one slice: of its buckets over the pieces that hold them; of slice -1 weighed by rows."""
    rows = table.sort_by("piece").to_pylist()  # sums in a fixed order
    part = rows[0]["slice"]
    if part < 0:
        weight = np.array([r["n"] for r in rows], np.float64)
        bucket = b""
        sums = [np.tensordot(weight / weight.sum(), np.stack([np.frombuffer(r[c], np.float32) for r in rows]), 1) for c in ("moved", "gained")]
    else:
        held, sums = np.zeros(SLICE), [np.zeros((SLICE, DIM)) for _ in range(2)]
        for r in rows:
            at = np.frombuffer(r["bucket"], np.uint16).astype(np.int64) - part * SLICE
            held[at] += 1
            for x, c in zip(sums, ("moved", "gained"), strict=True):
                x[at] += np.frombuffer(r[c], np.float32).reshape(-1, DIM)
        own = np.flatnonzero(held)
        bucket = (own + part * SLICE).astype(np.uint16).tobytes()
        sums = [x[own] / held[own, None] for x in sums]
    return pa.table({"slice": pa.array([part], pa.int32()), "bucket": [bucket], **{k: [x.astype(np.float32).tobytes()] for k, x in zip(("moved", "gained"), sums, strict=True)}})


def _calibrate_all(rows: DataFrame, net: Net) -> None:
    """`calibrate` on rows (label, words, lang) of any number: the driver receives counts and ends of bins of logits."""
    slim = Net(net.emb.astype(np.float32), net.filters, net.bias, net.out, net.base, np.zeros(LANGS + 1))
    shipped = rows.sparkSession.sparkContext.broadcast(pickle.dumps(slim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shipped.value))
        for b in batches:
            z = scorer.logits(_codes(b.column(1)), b.column(2).to_pylist())
            at = np.floor(np.clip(z, -LOGIT_MOST, LOGIT_MOST) * LOGIT_BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(at), pa.array(z)], ["lang", "label", "bin", "z"])

    found = rows.mapInArrow(run, "lang int, label int, bin long, z double").groupBy("lang", "bin")
    found = found.agg(F.count("*").alias("n"), F.sum("label").alias("hits"), F.min("z").alias("low"), F.max("z").alias("high"))
    _set_thresholds(net, found.toArrow().to_pandas().sort_values(["lang", "bin"]))


def toxicity(df: DataFrame, net: Net, text_col: str = "text"):
    """Column with the score of each whole text, 0 to 1; null and wordless texts are scored as texts without any cue.

    Equal texts have equal scores, whatever their other columns are; an empty table gives no scores.
    """
    slim = Net(net.emb.astype(np.float32), net.filters, net.bias, net.out, net.base, net.shift)
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(slim))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(pickle.loads(shipped.value))
        for batch in batches:
            texts = pack([t or "" for t in batch])
            yield pd.Series(_sigmoid(scorer.logits(texts, list(map(language, texts)))), index=batch.index)

    return run(F.col(text_col).cast("string"))
