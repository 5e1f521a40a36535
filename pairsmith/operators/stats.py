"""Statistics of sessions, of their logs and of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.functions.text import utrim

# What the log says when a gate has caught a reply.
CAUGHT = (("caught_incomplete", "incomplete output"), ("caught_refusals", "refusal"), ("caught_length", "finish_reason"))
REPORT_TERMINAL = (".", "!", "?", '"')


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole, scaled; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * F.lit(scale) / whole)


def session_stats(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, successes, failures, filtered rows, whole mean duration of a success, and the failure rate in percent."""
    ok = F.col("failure_reason").isNull() & ~F.coalesce(F.col("filtered"), F.lit(False))
    failed = F.col("failure_reason").isNotNull()
    out = results.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(failed).alias("failure"),
        F.count_if(~failed & F.coalesce(F.col("filtered"), F.lit(False))).alias("filtered"), F.coalesce(F.sum("duration_ns"), F.lit(0)).alias("total_duration_ns"),
    )
    average = F.when(F.col("success") > 0, F.expr("total_duration_ns div success")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("average_duration_ns", average).withColumn("failure_rate", share(F.col("failure"), F.col("total")))


def progress(all_jobs: DataFrame, done: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Completed and total jobs, and the percentage; 0 of nothing."""
    marked = all_jobs.join(done.select("job_id").distinct().withColumn("_done", F.lit(1)), "job_id", "left")
    out = marked.groupBy(*(by or [])).agg(F.count("_done").alias("completed"), F.count("*").alias("total"))
    return out.withColumn("percent", share(F.col("completed"), F.col("total")))


def success_rate(results: DataFrame, ok: Column, least: float) -> DataFrame:
    """The share of good rows, and whether it is enough to go on."""
    return results.agg(F.count_if(ok).alias("good"), F.count("*").alias("total")).withColumn("rate", share(F.col("good"), F.col("total"), 1.0)).withColumn("enough", F.col("rate") >= least)


def histogram(values: DataFrame, column: str, start: float, factor: float, n: int, by: list[str] | None = None) -> DataFrame:
    """Cumulative counts of values up to each of n exponential bounds, and up to any: one pass, one row of each group."""
    bounds = [start * factor**k for k in range(n)]
    counts = [F.count_if(F.col(column) <= b) for b in bounds] + [F.count(column)]
    out = values.groupBy(*(by or [])).agg(F.array(*counts).alias("c"))
    pairs = F.arrays_zip(F.array(*(F.lit(float(b)) for b in [*bounds, float("inf")])).alias("le"), F.col("c").alias("c"))
    return out.select(*(by or []), F.inline(pairs)).toDF(*(by or []), "le", "n")


def bench_metrics(log: DataFrame, by: list[str]) -> DataFrame:
    """Mean times, jobs a minute, mean wait for the rate limit and the share of jobs that waited."""
    waited = F.coalesce(F.col("rate_limit_wait_ms"), F.lit(0))
    out = log.groupBy(*by).agg(
        F.count("*").alias("jobs"), F.avg("chosen_ms").alias("chosen_ms"), F.avg("rejected_ms").alias("rejected_ms"), F.avg("total_ms").alias("total_ms"),
        F.avg(waited).alias("wait_ms"), share(F.count_if(waited > 0), F.count("*")).alias("blocking"), F.max("duration_s").alias("duration_s"),
    )
    return out.withColumn("throughput", F.when(F.col("duration_s") > 0, F.col("jobs") / (F.col("duration_s") / 60)).otherwise(F.lit(0.0)))


def best(metrics: DataFrame, order: str = "workers") -> DataFrame:
    """The row with the highest throughput, the first tested of several."""
    return metrics.orderBy(F.desc("throughput"), order).limit(1)


def completeness(text: Column) -> Column:
    """empty, complete or incomplete, by the report's own set of closing characters."""
    trimmed = utrim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.lit("empty")).when(F.right(trimmed, F.lit(1)).isin(*REPORT_TERMINAL), F.lit("complete")).otherwise(F.lit("incomplete"))


def reliability(records: DataFrame, log: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Records by completeness, and what the gates have caught by the log; success: records over records and caught ones."""
    kind = completeness(F.col(text))
    counts = records.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(kind == k).alias(k) for k in ("complete", "incomplete", "empty")))
    lowered = F.lower("msg")
    caught = log.groupBy(*by).agg(*(F.count_if(F.contains(lowered, F.lit(words))).alias(name) for name, words in CAUGHT))
    out = counts.join(caught, by, "left").na.fill(0, [name for name, _ in CAUGHT])
    every = F.col("total") + sum((F.col(name) for name, _ in CAUGHT), F.lit(0))
    return out.withColumn("success", share(F.col("total"), every))


def samples(records: DataFrame, by: list[str], text: str, order: str, n: int = 3) -> DataFrame:
    """The first n incomplete texts of each group, in order: a bounded window, not a collected list."""
    bad = records.where(completeness(F.col(text)) == "incomplete")
    return bad.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("rank") <= n)


def latest_sessions(log: DataFrame, least: int, n: int) -> DataFrame:
    """The n last sessions, by name, with ``least`` log lines of jobs or more."""
    return log.groupBy("session").agg(F.count("job_id").alias("jobs")).where(F.col("jobs") >= least).orderBy(F.desc("session")).limit(n)


def latest_by(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Of each group the row with the greatest ``order``, in one aggregation."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(by, "_r.*")
