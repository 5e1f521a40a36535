"""Checkpoints kept as one JSON file in a session's folder: read as tables, whatever their number, and taken over.

A checkpoint has the phase that a run has come to, its subtopics and jobs, and the ids of the jobs that are done. Each of these becomes
a table with the session's name; what is left to do and how far a session has come are joins and counts over them.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsmith.functions.text import is_blank, utrim
from pairsmith.operators import records, stats
from pairsmith.sources.sessions import MANIFEST, PHASES, Manifest, Session, SessionError
from pairsmith.sources.staging import written

CHECKPOINT = "checkpoint.json"
# The names of the fields in the file.
SCHEMA = (
    "session_id string, created_at string, last_saved_at string, current_phase string, subtopics_complete boolean, subtopics array<string>, prompts_complete boolean, "
    "prompts array<struct<ID:bigint,MainTopic:string,SubTopic:string,Prompt:string>>, failed_subtopics array<string>, prompt_success_rate double, completed_job_ids map<string,boolean>, "
    "stats struct<TotalPrompts:bigint,SuccessCount:bigint,FailureCount:bigint,FilteredCount:bigint,TotalDuration:bigint,AverageDuration:bigint>, config_hash string"
)
#: Where a session that is taken over keeps the ids of what is done, and what there was of its datasets.
ADOPTED = "adopted"
ADOPTED_LINES = {name: f"adopted_{name}" for name in ("dataset.jsonl", "dataset_reasoning.jsonl")}


def scan_checkpoints(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A row for each checkpoint file at ``path``, a glob or a file, with its session, the name of its folder.

    A file that is no checkpoint is skipped, or an error if ``strict``; what is missing in one that is, is null.
    """
    session = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return parse_checkpoints(spark.read.text(path, wholetext=True).select(session.alias("session"), "value"), strict)


def parse_checkpoints(files: DataFrame, strict: bool = False) -> DataFrame:
    """The same from (session, value) rows, the value being a file's content."""
    files = files.select("session", F.from_json("value", SCHEMA).alias("c"))
    bad = F.col("c").isNull() | F.col("c.current_phase").isNull()
    if strict:
        told = F.raise_error(F.concat(F.lit("no readable checkpoint: "), F.col("session"))).cast("string")
        return files.select(F.when(bad, told).otherwise(F.col("session")).alias("session"), "c.*")
    return files.where(~bad).select("session", "c.*")


def subtopics_of(checkpoints: DataFrame) -> DataFrame:
    """(session, sub_idx, sub_topic) in the order of the file."""
    return checkpoints.select("session", F.posexplode("subtopics").alias("sub_idx", "sub_topic")).withColumn("sub_idx", F.col("sub_idx").cast("long"))


def jobs_of(checkpoints: DataFrame) -> DataFrame:
    """(session, job_id, main_topic, sub_topic, prompt)."""
    return checkpoints.select("session", F.inline("prompts")).toDF("session", "job_id", "main_topic", "sub_topic", "prompt")


def completed_of(checkpoints: DataFrame) -> DataFrame:
    """(session, job_id) of the jobs that are done."""
    return checkpoints.select("session", F.explode("completed_job_ids").alias("id", "done")).where("done").select("session", F.col("id").cast("long").alias("job_id"))


def pending_of(checkpoints: DataFrame) -> DataFrame:
    """The jobs that are not done, of the sessions that have all of their jobs: before that there is nothing to go on with."""
    ready = checkpoints.where("prompts_complete")
    return jobs_of(ready).join(completed_of(ready), ["session", "job_id"], "left_anti")


def progress_of(checkpoints: DataFrame) -> DataFrame:
    """(session, phase, subtopics, completed, total, percent), 0 % of nothing; no shuffle, as a file has its own counts."""
    size = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("long")
    counts = checkpoints.select("session", F.col("current_phase").alias("phase"), size("subtopics").alias("subtopics"), size("completed_job_ids").alias("completed"), size("prompts").alias("total"))
    return counts.withColumn("percent", stats.share(F.col("completed"), F.col("total")))


def prompts_in(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, n): how many records of a dataset there are for each prompt, whatever their shape; an unpaired record is half of one."""
    shape = f"{records.SFT_SCHEMA}, prompt string, label boolean"
    lines = spark.read.text(path).select(F.from_json("value", shape).alias("r")).where("r is not null").select("r.*")
    asked = records.prompt_and_chosen(lines.withColumnRenamed("prompt", "_prompt"), "sharegpt").select("_prompt", "instruction", "label", F.col("prompt").alias("_talk"))
    prompt = utrim(F.coalesce("_prompt", "_talk", "instruction"))
    share = F.when(F.col("label").isNull(), F.lit(1.0)).otherwise(F.lit(0.5))
    return asked.select(prompt.alias("prompt"), share.alias("share")).where(~is_blank(F.col("prompt"))).groupBy("prompt").agg(F.floor(F.sum("share")).cast("long").alias("n"))


def written_jobs(jobs: DataFrame, there: DataFrame) -> DataFrame:
    """(job_id) of the jobs that the dataset has records for: of jobs with one prompt as many as it has records, the first ones."""
    numbered = jobs.withColumn("_p", utrim(F.col("prompt"))).withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("job_id")))
    return numbered.join(there.select(F.col("prompt").alias("_p"), "n"), "_p").where("_k <= n").select("job_id")


def adopt(spark: SparkSession, session: Session) -> Manifest:
    """Take a session over that another tool has begun, so that it can be resumed: its subtopics and jobs become tables, its records stay.

    Which jobs are done is told by the records there are, not by the checkpoint: that may lack what was written last, or count what was never
    written. The files of the old datasets are renamed, and their lines go into the new ones. A session with a manifest is left as it is.
    """
    if (session.folder / MANIFEST).exists():
        return Manifest.load(session.folder)
    file = session.folder / CHECKPOINT
    if not file.exists():
        raise SessionError(f"no checkpoint in {session.folder}")
    checkpoint = written(scan_checkpoints(spark, str(file), strict=True))
    state = checkpoint.select("current_phase", "config_hash", "subtopics_complete", "prompts_complete", "failed_subtopics", "prompt_success_rate", "created_at").first()
    if state.current_phase not in PHASES:
        raise SessionError(f"unknown phase {state.current_phase}")
    if state.current_phase == PHASES[-1]:
        raise SessionError("the session is complete")
    if state.subtopics_complete:
        subtopics_of(checkpoint).drop("session").write.mode("overwrite").parquet(session.path("subtopics"))
    if state.prompts_complete:
        jobs = jobs_of(checkpoint).drop("session")
        jobs.write.mode("overwrite").parquet(session.path("jobs"))
        for name, kept in ADOPTED_LINES.items():
            # A folder of that name is of this library.
            if (session.folder / name).is_file():
                os.replace(session.folder / name, session.folder / kept)
        old = session.folder / ADOPTED_LINES["dataset.jsonl"]
        done = written_jobs(jobs, prompts_in(spark, str(old))) if old.exists() else jobs.select("job_id").limit(0)
        done.write.mode("overwrite").parquet(session.path(ADOPTED))
    manifest = Manifest(session.name, state.config_hash, state.current_phase, state.created_at or "", failed_subtopics=state.failed_subtopics or [], prompt_success_rate=state.prompt_success_rate)
    manifest.save(session.folder)
    return manifest


def adopted_lines(spark: SparkSession, session: Session, name: str) -> DataFrame | None:
    """The lines that a session had in a dataset before it was taken over."""
    kept = Path(session.folder) / ADOPTED_LINES[name]
    return spark.read.text(str(kept)) if kept.exists() else None
