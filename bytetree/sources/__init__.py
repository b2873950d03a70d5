"""Where bytes come from: files, columns and buffers, as DataFrames with one source a row."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content): each file is a row; partition columns and path filters prune files."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def buffers(spark: SparkSession, data: dict[str, bytes]) -> DataFrame:
    """(name, content) of in-memory bytes."""
    return spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "name string, content binary")


def fixed_records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(content): the records of flat files of fixed-width records, split by byte range, so one huge file is many tasks.

    A file must hold whole records.
    """
    return spark.sparkContext.binaryRecords(path, width).map(lambda r: (bytearray(r),)).toDF("content binary")


def work_base(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where none is set, one in the warehouse, which is shared too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.work"


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name for files that executors share. `remove` deletes the folder, and so does the end of the program."""
    path = f"{work_base(spark)}/{kind}-{uuid.uuid4().hex}"
    keep_until_end(spark, path)
    return path


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the program ends."""
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is. DataFrames that read it are no longer usable."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_made: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:  # the session may have ended first
            remove(spark, path)


def with_extension(df: DataFrame, column: str = "path") -> DataFrame:
    return df.withColumn("extension", F.regexp_extract(column, r"(\.[^./]+)$", 1))
