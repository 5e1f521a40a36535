"""Scans of JSONL datasets and session logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.functions.text import is_blank, utrim
from pairsmith.operators import records
from pairsmith.sources.staging import written

LOG_SCHEMA = (
    "time string, level string, msg string, job_id bigint, chosen_ms bigint, rejected_ms bigint, judge_ms bigint, total_ms bigint, "
    "rate_limit_wait_ms bigint, is_rate_limit boolean, backoff bigint, duration bigint, total_prompts bigint, successful bigint, failed bigint"
)


#: A longer line is an error: no record has that many bytes, and it would have to fit a task's memory.
LONGEST_LINE = 16 << 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): the lines of each file with their numbers from 1, blank ones included.

    Splits of a file are counted, and the counts summed up in order: numbering takes no single task. A split is told by Spark's own
    partition of the scan, in which rows keep their order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = written(lines)
    from pyspark.sql import Window

    blocks = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.select("file", "start", "first", before.alias("before")), ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


def scan(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records with ``line_no``; blank lines are skipped. A line that is no JSON object is an error with its number, or skipped if not ``strict``."""
    return parse_lines(numbered_lines(spark, path), schema, strict)


def parse_lines(lines: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """The same from (line_no, line) rows."""
    lines = lines.where(~is_blank(F.col("line")))
    long = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(f" has more than {LONGEST_LINE} bytes"))).cast("string")
    lines = lines.withColumn("line", F.when(F.octet_length("line") > LONGEST_LINE, long).otherwise(F.col("line")))
    parsed = lines.select("line_no", F.from_json(utrim(F.col("line")), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    if not strict:
        return parsed.where(~bad).select("line_no", "r.*").drop("_corrupt")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" is no JSON object"))).cast("long")).otherwise(F.col("line_no"))
    return parsed.select(checked.alias("line_no"), "r.*").drop("_corrupt")


def scan_sft(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, records.SFT_SCHEMA)


def scan_dpo(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """Pairs; prompt and chosen reply must not be blank unless ``validate`` is false. The prompt stays as it is."""
    rows = scan(spark, path, records.DPO_SCHEMA)
    if not validate:
        return rows
    blank = is_blank(F.col("prompt")) | is_blank(F.col("chosen"))
    return rows.withColumn("line_no", F.when(blank, F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" lacks a prompt or a reply"))).cast("long")).otherwise(F.col("line_no")))


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with the session, the name of the folder they are in, and their file; lines that are no JSON are skipped."""
    session = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    lines = spark.read.text(path).select(session.alias("session"), F.col("_metadata.file_path").alias("path"), F.from_json("value", LOG_SCHEMA).alias("r"))
    return lines.where("r.msg is not null").select("session", "path", "r.*")
