"""Transforms of existing datasets: pairs from supervised records, new rejected replies for pairs.

Replies are written to a ledger, a table named by the caller, before anything is made of them; a transform that is run again asks only for
the lines whose replies are not there, and one whose calls failed ends with an error when all have been tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pairsmith.functions import template
from pairsmith.functions.text import clean_meta, combine_reasoning, has_think, is_blank, think_content, utrim, without_think
from pairsmith.operators import lists, records
from pairsmith.plans.defaults import TEMPLATES
from pairsmith.sources.providers import SCHEMA, Provider, prompt_key, replies
from pairsmith.sources.staging import written


class TransformError(RuntimeError):
    """Some lines got no reply."""


def ledger_of(spark, path: str) -> DataFrame:
    """The replies at ``path``, none if there is no such table."""
    schema = f"{SCHEMA}, key string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def has_replies(spark, path: str) -> bool:
    """Whether there is a ledger at ``path``."""
    try:
        return not spark.read.schema(f"{SCHEMA}, key string").parquet(path).isEmpty()
    except AnalysisException:
        return False


def replies_to(jobs: DataFrame, provider: Provider, stage: str, ledger: str | None = None) -> DataFrame:
    """(job_id, content) for each of (job_id, prompt): what the ledger has is read, the rest is asked for once and written to it first.

    A reply counts for the line and the prompt that it was given for. Without a ledger the replies are written to the session's folder.
    """
    spark = jobs.sparkSession
    keyed = jobs.select("job_id", "prompt").withColumn("key", prompt_key(F.lit(stage), F.col("prompt")))
    if ledger is None:
        found = written(replies(provider, keyed, stage))
        asked = keyed.join(found, "job_id")
    else:
        have = ledger_of(spark, ledger).where("error is null").select("job_id", "key")
        # Written down as well: the anti-join reads the table that the replies go to.
        todo = written(keyed.join(have, ["job_id", "key"], "left_anti"))
        replies(provider, todo, stage).join(todo.select("job_id", "key"), "job_id").write.mode("append").parquet(ledger)
        found = ledger_of(spark, ledger)
        asked = keyed.join(found, ["job_id", "key"])
    last = asked.groupBy("job_id").agg(F.max_by(F.struct("content", "error"), F.when(F.col("error").isNull(), 1).otherwise(0)).alias("r")).select("job_id", "r.*")
    failed = last.where("error is not null").agg(F.count("*").alias("n"), F.min(F.struct("job_id", "error")).alias("first")).first()
    if failed.n:
        raise TransformError(f"{failed.n} calls failed, the first one for line {failed['first'].job_id}: {failed['first'].error}")
    return last.select("job_id", "content")


def _rejected(completions: DataFrame, allow_empty: bool = False) -> DataFrame:
    """(job_id, rejected): trimmed and without talk about itself; an empty reply is an error."""
    reply = clean_meta(utrim(F.coalesce("content", F.lit(""))))
    if not allow_empty:
        reply = F.when(reply == "", F.raise_error(F.concat(F.lit("empty reply for job "), F.col("job_id").cast("string")))).otherwise(reply)
    return completions.select("job_id", reply.cast("string").alias("rejected"))


def _asked(rows: DataFrame, prompt: Column, text: str | None) -> DataFrame:
    """(job_id, prompt) by a template over the prompt and, where the records have them, the topics."""
    topic = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    fields = {"Prompt": prompt, "MainTopic": topic("main_topic"), "SubTopic": topic("sub_topic")}
    return rows.select("job_id", template.render(text or TEMPLATES["rejected"], fields).alias("prompt"))


def sft_to_dpo(scanned: DataFrame, style: str, provider: Provider, done: DataFrame | None = None, ledger: str | None = None, text: str | None = None) -> DataFrame:
    """(line_no, prompt, chosen, rejected) from supervised records with ``line_no``; lines already ``done`` are left out.

    ``text`` is the template by which rejected replies are asked for; it may name Prompt, MainTopic and SubTopic. A record without prompt or reply is
    an error that names its line.
    """
    rows = records.prompt_and_chosen(scanned, style)
    what = F.when(F.col("prompt").isNull(), F.lit("prompt")).when(F.col("chosen").isNull(), F.lit("reply"))
    checked = F.when(what.isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" has no "), what)).cast("string")).otherwise(F.col("prompt"))
    topics = [c for c in ("main_topic", "sub_topic") if c in rows.columns]
    jobs = rows.select(F.col("line_no").alias("job_id"), checked.alias("prompt"), "chosen", *topics)
    if done is not None:
        jobs = lists.pending(jobs, done)
    fresh = _rejected(replies_to(_asked(jobs, F.col("prompt"), text), provider, "rejected", ledger))
    return jobs.join(fresh, "job_id").select(F.col("job_id").alias("line_no"), "prompt", "chosen", "rejected")


def regenerated(pairs: DataFrame, completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plain, reasoned) pairs with new rejected replies, from (job_id, prompt, chosen, rejected) and (job_id, content).

    Plain: reasoning goes from the chosen reply if something is left. Reasoned: prompt and chosen reply as they were; the old
    rejected reply's reasoning stands before the new one.
    """
    both = pairs.withColumnRenamed("rejected", "_old").join(_rejected(completions), "job_id")
    bare = without_think(F.col("chosen"))
    plain = both.select("job_id", utrim(F.col("prompt")).alias("prompt"), F.when(has_think(F.col("chosen")) & (bare != ""), bare).otherwise(F.col("chosen")).alias("chosen"), "rejected")
    kept = F.when(has_think(F.col("_old")), think_content(F.col("_old")))
    return plain, both.select("job_id", "prompt", "chosen", combine_reasoning(kept, F.col("rejected")).alias("rejected"))


def _pending(scanned: DataFrame, done: DataFrame | None) -> DataFrame:
    jobs = scanned.select(F.col("line_no").alias("job_id"), "prompt", "chosen", "rejected")
    return jobs if done is None else lists.pending(jobs, done)


def _with_prompt(prompt: Column) -> Column:
    """The prompt; a blank one is an error that names its line."""
    blank = F.raise_error(F.concat(F.lit("line "), F.col("job_id").cast("string"), F.lit(" has no prompt"))).cast("string")
    return F.when(is_blank(prompt), blank).otherwise(prompt)


def regen_rejected(scanned: DataFrame, provider: Provider, done: DataFrame | None = None, ledger: str | None = None, text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``regenerated`` with replies from a provider, for pairs with reasoning and ``line_no`` that are not ``done``; a blank prompt is an error.

    Both frames come from the same written replies: each line is asked about once, by the template ``text`` over its trimmed prompt.
    """
    jobs = _pending(scanned, done)
    return regenerated(jobs, replies_to(_asked(jobs, utrim(_with_prompt(F.col("prompt"))), text), provider, "rejected", ledger))


def regen_plain(scanned: DataFrame, provider: Provider, done: DataFrame | None = None, ledger: str | None = None, text: str | None = None) -> DataFrame:
    """(job_id, prompt, chosen, rejected): pairs without reasoning with new rejected replies; prompt and chosen reply stay as they are, and so is the prompt asked."""
    jobs = _pending(scanned, done)
    fresh = _rejected(replies_to(_asked(jobs, _with_prompt(F.col("prompt")), text), provider, "rejected", ledger))
    return jobs.drop("rejected").join(fresh, "job_id").select("job_id", "prompt", "chosen", "rejected")
