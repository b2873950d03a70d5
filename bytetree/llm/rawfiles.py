"""Flat binary files through Spark's own writer, so they can go to any store that Spark can write to.

The text writer copies a string's bytes unchanged and puts the bytes of `lineSep` after each row; bytes cast to a string are not
re-encoded. Executors never open a path themselves, and the writer's commit protocol covers lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_raw(df: DataFrame, column: str, path: str, separator: bytes, records_per_file: int = 0) -> None:
    """Write a binary column to part files in the folder `path`, `separator` (not empty) after each row."""
    out = df.selectExpr(f"cast(`{column}` as string) as value").write.option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1")
    (out.option("maxRecordsPerFile", records_per_file) if records_per_file else out).text(path)


def read_raw(spark, path: str) -> DataFrame:
    """(path, content): one row for each part file of the folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
