"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

A document that language ID rejects goes; of equal texts the row with the largest doc_id stays, of near duplicates the one
with the least; the rest is dropped or repeated until its sources have their target shares, and encoded to pieces.

In every stage rows are told apart by doc_id and text, so a doc_id may be null or stand for several texts; texts may have any length that fits a task;
an empty table gives an empty one; other columns go along as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairsmith.llm.common import stage_folder
from pairsmith.llm.exact_dedup import drop_copies
from pairsmith.llm.langid import keep_identified
from pairsmith.llm.minhash import drop_near_copies
from pairsmith.llm.mixing import take_mix
from pairsmith.llm.sentencepiece import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the labelled rows have; null and empty texts, and those without a letter, go. Equal rows share their fate."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for the case of A-Z: that with the largest doc_id, a null being the least; null and empty texts are one group."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the least doc_id, a null being the largest; texts without words all stay, of equal rows one."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are dropped or repeated, up to three times, until sources have their target shares; null is a source, the last. Rows without words go with their source's rate."""
    return take_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the pieces of the text, none for a null or empty one; a row for each row."""
    return encode_documents(docs, keep=("doc_id", "lang", "source"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Kernels, near duplicates, seeded rounding and pieces have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), stage_folder(spark)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
