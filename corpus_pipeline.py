"""A training corpus in five stages: quality classifier, near-duplicates, benchmark decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. A caller
writes each result as Parquet and passes what it reads back to the next stage.

Odd rows, in every stage: a null text counts as an empty one; a null id, source or language is a value of its own; rows that repeat
others are rows like them until the near-duplicate stage drops them; an empty table gives an empty table; further columns come
along, whatever they are called, through all stages but the last; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytetree.llm.decontaminate import decontaminate
from bytetree.llm.mixing import apply_mix
from bytetree.llm.quality import keep_good
from bytetree.llm.sharding import assign_shards
from bytetree.llm.simhash import drop_similar
from bytetree.sources import remove, work_folder

SHARDS = 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose combined evidence is against them go. Empty and null texts are judged by their site and the fit's bias."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 in its form for shingle similarity (five words, 0.8): one document of each group stays, that of the smallest id.

    SimHash and the vantage-point tree find what lies within two bits, files of smallest hashes what lies beyond; the similarity of
    shingles decides both. Texts without words are one group; of ties in the id the smallest text hash stays, nulls last.
    """
    return drop_similar(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents go in which windows of any benchmark item cover eight words or the whole text, or a whole item of five to seven words lies.

    Texts without words stay; an empty benchmark removes nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the mix takes its first word, in the order of the schedule. Texts without words go."""
    return apply_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: where each row goes; a null id goes where zero does."""
    return assign_shards(docs, SHARDS).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: A trained classifier and a component search aren't SQL: tests/llm/test_pipeline.py holds each stage, on its own input, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read back by the next, and deleted when that is written.
    What the last stage reads is deleted when the program ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
