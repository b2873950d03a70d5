"""Files as they arrive: the same expressions over a stream of sources. Decoding keeps no state between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import Session


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame with one row for each new file."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def stream_rows(session: Session, expr: str, name: str, path: str, **options) -> DataFrame:
    """Rows of the array that `expr` names, for each file that arrives under path."""
    session.add_data_source(name, file_stream(session.spark, path, **options), "content")
    return session.eval(expr).rows()
