"""Generated lists: ordered deduplication, trimming, exclusion lists, jobs with dense ids, chunks of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.functions.text import utrim
from pairsmith.sources.staging import written


def dedup_ordered(items: DataFrame, item: str = "item", pos: str = "pos") -> DataFrame:
    """(item, pos): the first of the items that are equal when trimmed and lower-cased, trimmed; blank ones go.

    One aggregation with map-side combination; a frequent item is no hot spot.
    """
    text = utrim(F.col(item))
    return items.where(text != "").groupBy(F.lower(text).alias("_key")).agg(F.min_by(text, F.col(pos)).alias(item), F.min(pos).alias(pos)).drop("_key")


def take_first(items: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first ``n`` by position: the target count, a top-k and no full sort."""
    return items.orderBy(pos).limit(n)


def last_n(items: Column, n: int) -> Column:
    """struct(items, truncated): the last ``n`` elements."""
    size = F.size(items)
    return F.struct(F.slice(items, F.greatest(size - (n - 1), F.lit(1)), F.lit(n)).alias("items"), (size > n).alias("truncated"))


def merge_requests(*batches: DataFrame) -> DataFrame:
    """All batches of (item, pos), renumbered so that later batches come after earlier ones."""
    out = None
    for k, batch in enumerate(batches):
        part = batch.select("item", F.struct(F.lit(k).alias("batch"), F.col("pos").cast("long").alias("pos")).alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out


def chunks(spark, total: int, size: int) -> DataFrame:
    """(chunk_no, n): how many to ask for in each request."""
    return spark.range(0, max(0, -(-total // size))).select(F.col("id").alias("chunk_no"), F.least(F.lit(size), F.lit(total) - F.col("id") * size).cast("int").alias("n"))


def dense_ids(rows: DataFrame, order: list[str], name: str = "job_id") -> DataFrame:
    """``rows`` with dense ids from 0 in the order of the columns.

    Rows are range-partitioned and counted by partition, so that numbering takes no single task; the counts, one for each
    partition, are the only thing that is summed up in order.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # Written down: ranges come from a sample, and another evaluation might draw another one.
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def duplicate_counts(items: DataFrame, item: str = "item") -> DataFrame:
    """One row (elements, duplicates): items that are not blank, and those beyond the first of each, trimmed and case ignored."""
    text = utrim(F.col(item))
    kinds = items.where(text != "").groupBy(F.lower(text).alias("_key")).agg(F.count("*").alias("n"))
    return kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("elements"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def jobs(subtopics: DataFrame) -> DataFrame:
    """(job_id, main_topic, sub_topic, prompt) from (sub_idx, main_topic, sub_topic, prompts): one job for each prompt, in order.

    Subtopics that failed have null prompts and give none.
    """
    rows = subtopics.select("sub_idx", "main_topic", "sub_topic", F.posexplode("prompts").alias("pos", "prompt"))
    return dense_ids(rows, ["sub_idx", "pos"]).select("job_id", "main_topic", "sub_topic", "prompt")


def pending(all_jobs: DataFrame, done: DataFrame) -> DataFrame:
    """The jobs whose ids are not among the done ones."""
    return all_jobs.join(done.select("job_id"), "job_id", "left_anti")


def retried(first: DataFrame, again: DataFrame, key: str, value: str) -> DataFrame:
    """Results with those of a second attempt, where there are some, in place of the first."""
    other = again.select(key, F.col(value).alias("_again"))
    return first.join(other, key, "left").withColumn(value, F.coalesce("_again", value)).drop("_again")
