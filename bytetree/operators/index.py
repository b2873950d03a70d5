"""Indexes of large keyed or variable-length arrays, written once as Parquet and read back with pruning.

* A key index holds a row for each keyed item. It is dealt by a hash of the key, in pieces of like size, and sorted by key, so that
  a lookup skips files by their Bloom filters and row groups by their ranges.
* An offset index holds the place of every EVERY-th item, so that the n-th item of an array of variable items is found by
  decoding at most EVERY - 1 items before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 32


def write_key_index(nodes: DataFrame, path: str, keys: list[str], files: int = 8) -> None:
    """Write (keys, parent_id, ordinal, twin, offset, size, key) of the keyed items of a node table to `path`.

    Small tables make few files, large ones at least `files`: adaptive execution deals a key that is in very many items to several.
    """
    keyed = nodes.filter("key_bin is not null or key_int is not null")
    key = F.coalesce(F.col("key_bin"), F.encode(F.col("key_int").cast("string"), "UTF-8")).alias("key")
    rows = keyed.select(*keys, "parent_id", "ordinal", "twin", "offset", "size", key)
    parts = max(files, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.hint("rebalance", parts, "key").sortWithinPartitions("key", *keys, "ordinal")
    dealt.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled#key", "true").parquet(path)


def by_index(spark: SparkSession, path: str, key: bytes | int, twin: int | None = 0) -> DataFrame:
    """The items with the key, from an index; twin None gives all that share it. The condition reaches the scan."""
    raw = str(key).encode() if isinstance(key, int) else key
    found = spark.read.parquet(path).filter(F.col("key") == F.lit(bytearray(raw)))
    return found if twin is None else found.filter(F.col("twin") == twin)


def write_offset_index(nodes: DataFrame, path: str, keys: list[str], every: int = EVERY) -> None:
    """Write (keys, parent_id, mark, offset) of every `every`-th item of a node table's arrays to `path`."""
    items = nodes.filter("name is null and parent_id is not null").filter(F.col("ordinal") % every == 0)
    marks = items.select(*keys, "parent_id", F.expr(f"ordinal div {every}").alias("mark"), "offset")
    marks.sortWithinPartitions(*keys, "parent_id", "mark").write.parquet(path)


def nearest_mark(spark: SparkSession, path: str, n: int, every: int = EVERY) -> DataFrame:
    """(keys, parent_id, offset, ahead): where to begin decoding to get at item n, and how many items lie before it from there."""
    marks = spark.read.parquet(path).filter(F.col("mark") == n // every)
    return marks.withColumn("ahead", F.lit(n % every)).drop("mark")
