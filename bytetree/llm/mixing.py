"""Mixing sources to target weights by a low-discrepancy schedule, in built-in functions only.

The mix is a sequence of slots, each of which takes one block of BLOCK words of a source's shuffled texts. Van der Corput points
(bit-reversed slot numbers) fall through the cumulative weights of the sources, so every stretch of the sequence holds each source
close to its share. The r-th slot of a source, in sequence order, takes its r-th block, starting over after the last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, cut, fresh, text_hash
from .words import word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK = 2048
CHUNK = 1 << 16  #: slots made by one task at most
BUCKET = 1 << 13  #: slots, or rows, aimed at in one bucket of a running sum
PART_WORDS = 10_000_000  #: words aimed at in a partition of the written mix


@dataclass
class Mix:
    rows: DataFrame  #: (id, source, size, source_size, target, taken, position, *extra): position is that of the first slot that takes a word of the row, null if none does
    sources: DataFrame  #: (source, s, size, weight, target, words, blocks, rest, slots, first): one row for each source
    schedule: DataFrame  #: (s, position, rank, epoch, block, limit): one row for each slot
    bits: int  #: positions are below 2 ** bits


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, size) -> one row for each source with its target: shares by weight of all sizes, a target stops at `most` times
    its source's size, and the excess is shared anew among the others, until none is above.

    The share of one unit of weight is found in one pass over the sources in order of the unit share at which each would stop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    t = sizes.select("source", "size", (F.row_number().over(order) - 1).alias("s"), w.alias("weight"), (most * F.col("size")).alias("cap"))
    stop = F.col("cap") / F.col("weight")
    by = Window.orderBy("stop", "s")
    t = t.withColumn("stop", stop)
    left = F.sum("size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unit = left / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("unit", unit)
    unit = F.min(F.when(F.col("unit") <= F.col("stop"), F.struct("stop", "s", "unit"))).over(Window.partitionBy())["unit"]
    return t.select("source", "s", "size", "weight", F.coalesce(F.least(F.col("cap").cast("double"), unit * F.col("weight")), F.lit(0.0)).alias("target"))


def _reversed(j: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(j), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def _running(df: DataFrame, bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """df with `name`, the sum of value over the rows of the same s before each row: sums of buckets first, then ranks inside a bucket."""
    df = df.withColumn("__b", bucket).withColumn("__v", value)
    sums = df.groupBy("s", "__b").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy("s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("s", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0))).join(sums, ["s", "__b"])
    return out.withColumn(name, F.col("__base") + F.col("__in")).drop("__b", "__v", "__t", "__base", "__in")


@dataclass
class _Plan:
    none: DataFrame  # rows without words
    some: DataFrame  # the others, with s and begin, where the row starts among its source's words
    sources: DataFrame
    slots: DataFrame
    bits: int


def _schedule(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, block: int, extra: dict[str, Column]) -> _Plan:
    ident = F.col(id_col).cast("long")
    size = word_count(F.col(text_col).cast("string")).alias("size")
    rows = cut(df.select(ident.alias("id"), F.col(source_col).cast("string").alias("source"), size, *(c.alias(k) for k, c in extra.items())))
    t = targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, most)
    t = t.withColumn("words", F.floor(F.col("target") + 0.5)).withColumn("blocks", F.ceil(F.col("size") / block))
    t = t.withColumn("rest", F.coalesce(F.expr("words % nullif(size, 0)"), F.lit(0)))
    slots = F.coalesce(F.expr("words div nullif(size, 0)"), F.lit(0)) * F.col("blocks") + F.ceil(F.col("rest") / block)
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    t = cut(t.withColumn("slots", slots).withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0))))
    n_slots = t.agg(F.sum("slots")).first()[0] or 0
    bits = max(0, (int(n_slots) - 1).bit_length())

    zero = F.lit(0).cast("long")
    chunks = t.filter("slots > 0").select("s", "first", "slots", "blocks", "rest", F.explode(F.sequence(zero, F.expr(f"(slots - 1) div {CHUNK}"))).alias("chunk")).repartition("s", "chunk")
    own = F.sequence(F.col("first") + F.col("chunk") * CHUNK, F.col("first") + F.least("slots", (F.col("chunk") + 1) * CHUNK) - 1)
    slots = chunks.select("s", "slots", "blocks", "rest", F.explode(own).alias("j")).withColumn("position", _reversed(F.col("j"), bits))
    slots = _running(slots, F.shiftright("position", min(bits, 13)).cast("long"), ["position"], F.lit(1).cast("long"), "rank")
    slots = slots.withColumn("epoch", F.expr("`rank` div blocks")).withColumn("block", F.expr("`rank` % blocks"))
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    limit = F.when(last, F.col("rest") - F.col("block") * block).otherwise(F.lit(block))
    slots = slots.select("s", "position", "rank", "epoch", "block", limit.alias("limit"))

    known = t.select("source", "s", F.col("size").alias("source_size"), "target")
    placed = rows.withColumnRenamed("source", "src").join(known, F.col("src").eqNullSafe(F.col("source"))).drop("src")
    mix = F.pmod(F.pmod(F.coalesce("id", "size"), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(97531), F.lit(1 << 32))
    buckets = rows.count() // BUCKET + 1
    some = placed.filter("size > 0").withColumn("mix", mix)
    bucket = F.shiftright(F.col("mix") * F.lit(buckets), 32)
    some = _running(some, bucket, ["mix", F.col("id").asc_nulls_first(), "size"], F.col("size"), "begin").drop("mix")
    return _Plan(placed.filter("size = 0"), some, t, slots, bits)


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS, block: int = BLOCK, extra: dict[str, Column] | None = None,
) -> Mix:
    """Plan the mix of all rows. Sources in order of their code points, null last, weigh `weights`, repeating.

    size: words of the text (null: none). taken: words the mix takes from the row, repeats counted; never over `most` times its
    size. position: where in the sequence the mix first takes one of the row's words. Together a source's rows give its target
    rounded to a whole word. Equal inputs give equal mixes: the order of a source's texts is a fixed mix of the id (of the size
    where that is null), then id and size. Rows without words take nothing and have no position; repeated rows each take their
    own; an empty table gives no rows and no slots. extra: columns to carry along.

    Running sums over a source, and ranks of its slots, go by buckets of at most about BUCKET rows, so a source with most rows is no
    single task. The per-source table is the only one that meets in one task: a few numbers for each source. Rows that repeat
    one id share its bucket.
    """
    extra = extra or {}
    plan = _schedule(df, id_col, text_col, source_col, weights, most, block, extra)
    keys = ["s", "begin"]
    blocks = F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))
    pieces = plan.some.select(*keys, "size", F.explode(blocks).alias("block"))
    a, b = F.col("begin") - F.col("block") * block, F.col("begin") + F.col("size") - F.col("block") * block
    pieces = pieces.select(*keys, "block", F.greatest(a, F.lit(0)).alias("a"), F.least(b, F.lit(block)).alias("b"))
    full = F.col("limit") >= block
    takes = plan.slots.groupBy("s", "block").agg(
        F.count(F.when(full, 1)).alias("whole"), F.coalesce(F.max(F.when(~full, F.col("limit"))), F.lit(0)).alias("part"),
        F.min(F.when(full, F.col("position"))).alias("at_whole"), F.min(F.when(~full, F.col("position"))).alias("at_part"),
    )
    words = F.col("whole") * (F.col("b") - F.col("a")) + F.greatest(F.least("b", "part") - F.col("a"), F.lit(0))
    at = F.coalesce("at_whole", F.when(F.col("part") > F.col("a"), F.col("at_part")))  # a part is the source's last slot
    got = pieces.join(takes, ["s", "block"]).groupBy(*keys).agg(F.sum(words).alias("taken"), F.min(at).alias("position"))
    cols = ["id", "source", "size", "source_size", "target"]
    some = plan.some.join(got, keys, "left").select(*cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position", *extra)
    none = plan.none.select(*cols, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("position"), *extra)
    return Mix(some.union(none), plan.sources, plan.slots, plan.bits)


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK) -> DataFrame:
    """df's rows in the order of the schedule: each as often as the mix takes its first word, at the slots that do.

    So every stretch of the result, which is sorted across its partitions and within each, holds each source close to its share,
    and a source's words differ from its target by less than one text for each time the mix goes through it. Rows without words
    are left out. Rows that repeat id and text each come as often as the most taken of them; null ids match nulls; an empty
    table gives no rows; extra columns come along.

    A slot holds at most `block` first words, so no task gets more than its stretch of slots, however large a source is. The
    texts are shuffled once, to the stretch they belong to.
    """
    plan = _schedule(df, id_col, text_col, source_col, weights, most, block, {"h": text_hash(F.col(text_col))})
    starts = plan.some.select("id", "h", "s", "begin", F.expr(f"begin div {block}").alias("block"))
    met = starts.join(plan.slots, ["s", "block"]).filter(F.col("limit") > F.col("begin") - F.col("block") * block)
    each = met.groupBy("id", "h", "s", "begin").agg(F.sort_array(F.collect_list("position")).alias("at"))  # at most `most` positions
    best = each.groupBy("id", "h").agg(F.max(F.struct(F.size("at").alias("n"), F.col("at"))).alias("best"))
    keys = cut(best.select("id", "h", F.col("best.at").alias("at")))
    at, name = fresh(df, "key_at"), fresh(df, "mix_position")
    out = by_text(df, keys, id_col, text_col, "inner").withColumn(name, F.explode(at))
    parts = _parts(df.sparkSession, plan, block)
    where = F.shiftright(F.col(name) * parts, plan.bits).cast("int")
    return out.select(*df.columns, name).repartitionById(parts, where).sortWithinPartitions(name).drop(name)


def _parts(spark, plan: _Plan, block: int) -> int:
    """Stretches of the sequence, by PART_WORDS words or so; the session's number of shuffle partitions where that is more."""
    slots = plan.sources.agg(F.sum("slots")).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(slots * block // PART_WORDS))
