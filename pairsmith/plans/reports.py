"""Reports over sessions: which there are, how reliable their models were, how fast they ran; runs of one configuration with several numbers of workers.

Logs and datasets of all sessions are read as tables; a report has a row for each session, provider or number of workers.
"""

from __future__ import annotations

import dataclasses
import json
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.functions.naming import PROVIDERS
from pairsmith.operators import stats
from pairsmith.sources import jsonl
from pairsmith.sources.config import Config

TEXTS = "prompt string, chosen string, completion string, label boolean, output string, conversations array<struct<from:string,value:string>>"
#: What of a reliability report is added up over a provider's sessions.
COUNTS = ("total", "complete", "incomplete", "empty", *(name for name, _ in stats.CAUGHT))
KINDS = ("sessions", "reliability", "providers", "samples", "benchmark")


def job_log(spark: SparkSession, output: str) -> DataFrame:
    """The log lines of all sessions' jobs, with the session."""
    log = jsonl.scan_log(spark, f"{output}/*/session_jobs")
    return log.withColumn("session", F.regexp_extract(F.col("path"), r"(session_[^/]+)/[^/]+/[^/]*$", 1))


def texts_of(spark: SparkSession, output: str) -> DataFrame:
    """(session, prompt, text): the chosen replies in all sessions' datasets, of any shape."""
    records = spark.read.json(f"{output}/*/dataset.jsonl", schema=TEXTS)
    session = F.regexp_extract(F.col("_metadata.file_path"), r"(session_[^/]+)/[^/]+/[^/]*$", 1)
    said = F.try_element_at(F.filter("conversations", lambda t: t["from"].isin("gpt", "assistant")), F.lit(-1))["value"]
    # An unpaired record counts if it is the good one.
    return records.where(F.coalesce("label", F.lit(True))).select(session.alias("session"), "prompt", F.coalesce("chosen", "completion", "output", said).alias("text"))


def providers_of(spark: SparkSession, output: str, sessions: list[str]) -> DataFrame:
    """(session, provider, workers) by the copies of their configurations; null where there is none. The sessions are as many as a report has."""
    rows = []
    for name in sessions:
        try:
            kept = tomllib.loads((Path(output) / name / "config.toml.bak").read_text())
        except (OSError, ValueError):
            kept = {}
        url = kept.get("models", {}).get("main", {}).get("base_url")
        rows.append((name, None if url is None else next((p for part, p in PROVIDERS if part in url), url), kept.get("generation", {}).get("concurrency")))
    return spark.createDataFrame(rows, "session string, provider string, workers long")


def reliability(spark: SparkSession, output: str, chosen: DataFrame) -> DataFrame:
    """A row for each of the chosen sessions: its records by completeness, what the gates caught, success in percent, and its provider."""
    log = job_log(spark, output)
    texts = texts_of(spark, output).join(chosen.select("session"), "session")
    names = [r.session for r in chosen.select("session").collect()]
    return stats.reliability(texts, log, ["session"]).join(providers_of(spark, output, names).drop("workers"), "session", "left")


def by_provider(rows: DataFrame) -> DataFrame:
    """Reliability rows added up by provider, with the success of the latest session of each."""
    every = sum((F.col(c) for c in ("total", *(name for name, _ in stats.CAUGHT))), F.lit(0))
    latest = F.max_by(F.struct("session", "success"), F.col("session"))
    out = rows.groupBy("provider").agg(F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in COUNTS), latest.alias("_l"))
    return out.withColumns({"success": stats.share(F.col("total"), every), "latest": F.col("_l.session"), "latest_success": F.col("_l.success")}).drop("_l")


def benchmark(spark: SparkSession, output: str, chosen: DataFrame) -> DataFrame:
    """Times and throughput of each of the chosen sessions, with its number of workers."""
    runs = jsonl.scan_log(spark, f"{output}/*/session.log").where("msg = 'session complete'").groupBy("session").agg(F.max(F.col("duration") / 1e9).alias("duration_s"))
    out = stats.bench_metrics(job_log(spark, output).join(runs, "session").join(chosen.select("session"), "session"), ["session"])
    names = [r.session for r in chosen.select("session").collect()]
    return out.join(providers_of(spark, output, names).drop("provider"), "session", "left")


def report(spark: SparkSession, kind: str, output: str, least: int = 1, last: int = 20) -> DataFrame:
    """One of ``KINDS`` over the ``last`` sessions that have ``least`` jobs or more."""
    chosen = stats.latest_sessions(job_log(spark, output), least, last)
    if kind == "sessions":
        return chosen
    if kind == "benchmark":
        return benchmark(spark, output, chosen).orderBy("session")
    if kind == "samples":
        texts = texts_of(spark, output).join(chosen.select("session"), "session")
        return stats.samples(texts, ["session"], "text", "prompt").select("session", "rank", "prompt", F.right("text", F.lit(100)).alias("ends")).orderBy("session", "rank")
    rows = reliability(spark, output, chosen)
    return rows.orderBy("session") if kind == "reliability" else by_provider(rows).orderBy("provider")


def markdown(columns: list[str], rows: list[tuple]) -> str:
    """A table; numbers with two decimals at most."""
    show = lambda v: "" if v is None else f"{v:.2f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *([show(v) for v in r] for r in rows)]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def save(out: DataFrame, csv: str | None = None, as_json: str | None = None, as_markdown: str | None = None) -> list[tuple]:
    """Keep a report, which has few rows, as CSV in a folder, as one JSON file or as a table; its rows."""
    rows = [tuple(r) for r in out.collect()]
    if csv:
        out.coalesce(1).write.mode("overwrite").option("header", True).csv(csv)
    if as_json:
        Path(as_json).write_text(json.dumps([dict(zip(out.columns, r, strict=True)) for r in rows], indent=1) + "\n")
    if as_markdown:
        Path(as_markdown).write_text(markdown(out.columns, rows))
    return rows


def sweep(config: Config, workers: list[int], run: Callable[[Config], dict]) -> list[dict]:
    """``run`` for the configuration with each number of workers in turn; a run that fails has its error, and the others go on."""
    out = []
    for n in workers:
        one = dataclasses.replace(config, generation=dataclasses.replace(config.generation, concurrency=n))
        try:
            out.append({"workers": n, **run(one)})
        except Exception as e:  # noqa: BLE001
            out.append({"workers": n, "error": f"{type(e).__name__}: {e}"})
    return out


def best_of(results: list[dict]) -> dict | None:
    """The run with the highest throughput, the first tested of several."""
    done = [r for r in results if "error" not in r]
    return max(done, key=lambda r: r["throughput"], default=None)
