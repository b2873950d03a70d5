"""Jump consistent hashing (Lamping and Veach, 2014): a key and a shard count give the shard, with no table to keep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of

STEP = np.uint64(2862933555777941757)  # fixed value of the published algorithm
SLOT_ROWS = 20_000  #: rows aimed at in one block of the slot numbering


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of each unsigned 64-bit key among `shards` buckets; about ln(shards) rounds over the whole array."""
    key = keys.astype(np.uint64, copy=True)
    bucket, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        bucket[going] = ahead[going]
        key[going] = key[going] * STEP + np.uint64(1)
        draw = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[going] = ((bucket[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        going = going[ahead[going] < shards]
    return bucket


def jump_shard(col, shards: int):
    """Column form of `jump` for a long column; a null key counts as zero."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(F.coalesce(col.cast("long"), F.lit(0)))


def assign_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): one row for each input row; the text itself is never shuffled.

    size: UTF-8 bytes plus one (null: one). text_crc32: unsigned (null: that of the empty text, zero). Law `key`: id and shard
    count alone decide, and `grown_shard`, the shard under one more shard, differs from `shard` only where it is the new one.
    slot: 0, 1, ... within the shard, by a mix of the id, then id, checksum and size; repeated rows get neighbouring slots.
    A null id goes where zero goes; an empty table gives no rows; other columns are ignored.

    Slots are numbered in two levels - a count for each shard and block of the mix, running sums over these few counts, then
    ranks inside a block - so no task sorts a whole shard. The number of blocks follows the row count. Null ids are mixed by
    their checksum and spread like any others.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_of(F.col(text_col)).alias("text_crc32"),
    )
    rows = rows.select("*", jump_shard(F.col("id"), shards).alias("shard"), jump_shard(F.col("id"), shards + 1).alias("grown_shard"))
    mix = F.pmod(F.pmod(F.coalesce("id", "text_crc32"), F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))
    blocks = max(1, df.select(id_col).count() // (SLOT_ROWS * shards) + 1)
    rows = rows.withColumn("mix", mix).withColumn("block", F.shiftright(F.col("mix") * F.lit(blocks), 32).cast("int"))
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("mix", F.col("id").asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "block"]).select("id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
