"""The generation pipeline: a topic becomes subtopics, these prompts, these pairs of replies, these records.

Each phase is written as a table before the next reads it: completions cost money and differ each time, so nothing is asked for
twice. Replies are written slice by slice to a ledger; a run that ended in the middle of a phase asks only for what the ledger lacks. A phase that is
there as a whole is read on resume; pending jobs are those without a row among the written pairs.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.functions import template
from pairsmith.functions.jsonkit import strings_of
from pairsmith.functions.naming import over_request
from pairsmith.functions.text import is_blank
from pairsmith.operators import gates, judging, lists, records, stats
from pairsmith.plans.defaults import CRITERIA, FILTER_CRITERIA, TEMPLATES
from pairsmith.plans.transforms import ledger_of
from pairsmith.sources.checkpoints import ADOPTED, adopted_lines
from pairsmith.sources.config import Config
from pairsmith.sources.providers import Provider, prompt_key, replies
from pairsmith.sources.sessions import MANIFEST, Manifest, Session, config_hash
from pairsmith.sources.sinks import JsonLines
from pairsmith.sources.staging import is_written, written

PAIR_COLUMNS = ("job_id", "main_topic", "sub_topic", "prompt", "chosen", "chosen_reasoning", "rejected", "rejected_reasoning", "finish_reason", "failure_reason", "chosen_ns", "rejected_ns", "chosen_wait_ns", "rejected_wait_ns", "attempt")
#: Replies are written in slices of about this many calls.
SLICE = 10_000
#: Failure reasons of rows whose calls failed.
CALL_FAILED = "call failed"


class PipelineError(RuntimeError):
    """A phase gave too little to go on."""


@dataclass
class Pipeline:
    """``providers`` has one for each of main, rejected and judge, as far as the mode needs them."""

    spark: SparkSession
    config: Config
    session: Session
    providers: dict[str, Provider]
    templates: dict[str, str] = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        self.templates = {**TEMPLATES, **self.config.prompt_templates, **self.templates}
        g = self.config.generation
        self.hash = config_hash(g.main_topic, g.num_subtopics, g.num_prompts_per_subtopic)
        self.manifest = Manifest(self.session.name, self.hash)
        # What a run before has found out stays, if it had the same configuration.
        if (self.session.folder / MANIFEST).exists() and (before := Manifest.load(self.session.folder)).config_hash == self.hash:
            self.manifest = before

    def _ask(self, provider: str, stage: str, rows: DataFrame, fields: dict, key: str = "job_id", ledger: str | None = None) -> DataFrame:
        """The replies to a rendered template, by job_id, from the ledger of that name (the stage's own), which gets what it lacks first.

        A reply counts for the job and the prompt that it was given for; calls that failed are in the ledger with their errors and are
        made again when the stage is.
        """
        asked = written(rows.select(F.col(key).cast("long").alias("job_id"), template.render(self.templates[stage], fields).alias("prompt")))
        keyed = asked.withColumn("key", prompt_key(F.lit(stage), F.col("prompt")))
        path = self.session.path(f"replies_{ledger or stage}")
        todo = written(keyed.join(ledger_of(self.spark, path).where("error is null").select("job_id", "key"), ["job_id", "key"], "left_anti"))
        slices = -(-todo.count() // SLICE)
        for number in range(slices):
            part = todo.where(F.pmod(F.xxhash64("job_id"), F.lit(slices)) == number)
            given = replies(self.providers[provider], part.select("job_id", "prompt"), stage)
            given.join(part.select("job_id", "key"), "job_id").write.mode("append").parquet(path)
        found = keyed.join(ledger_of(self.spark, path), ["job_id", "key"])
        good = F.when(F.col("error").isNull(), 1).otherwise(0)
        return found.groupBy("job_id").agg(F.max_by(F.struct("content", "reasoning_content", "finish_reason", "error", "duration_ns", "wait_ns"), good).alias("r")).select("job_id", "r.*")

    def _stage(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.session.path(name))
        return self.spark.read.parquet(self.session.path(name))

    def _written(self, name: str) -> bool:
        return is_written(self.spark, self.session.path(name))

    # Phase one.

    def _request_subtopics(self, count: int, exclude: str, part: str) -> DataFrame:
        g = self.config.generation
        size = g.subtopic_chunk_size or count
        asked = lists.chunks(self.spark, count, size)
        answers = self._ask("main", "subtopics", asked, {"MainTopic": F.lit(g.main_topic), "NumSubtopics": F.col("n"), "Count": F.col("n"), "IsRetry": F.lit(bool(exclude)), "ExcludeSubtopics": F.lit(exclude), "Exclude": F.lit(exclude)}, "chunk_no", f"subtopics_{part}")
        items = answers.select("job_id", F.posexplode(strings_of(1)("content")).alias("at", "item"))
        return self._stage(f"subtopics_{part}", items.select("item", (F.col("job_id") * 1_000_000 + F.col("at")).alias("pos")))

    def subtopics(self) -> DataFrame:
        """(sub_idx, sub_topic): asked for in chunks, a few more than needed; once more for what is missing, without those there are."""
        if self._written("subtopics"):
            return self.spark.read.parquet(self.session.path("subtopics"))
        g = self.config.generation
        first = self._request_subtopics(over_request(g.num_subtopics, g.over_generation_buffer), "", "first")
        unique = lists.dedup_ordered(first)
        have = unique.count()
        if have < g.num_subtopics:
            # The list is as long as the target, which the configuration bounds.
            known = [r.item for r in unique.orderBy("pos").collect()]
            exclude = ", ".join(known[-g.max_exclusion_list_size :] if g.max_exclusion_list_size else [])
            again = self._request_subtopics(g.num_subtopics - have, exclude, "again")
            unique = lists.dedup_ordered(lists.merge_requests(first, again))
        counts = lists.duplicate_counts(self.spark.read.parquet(self.session.path("subtopics_first")), "item").first()
        self.session.log("subtopics", elements=counts.elements, duplicates=counts.duplicates)
        kept = lists.take_first(unique, g.num_subtopics)
        found = self._stage("subtopics", lists.dense_ids(kept, ["pos"], "sub_idx").select("sub_idx", F.col("item").alias("sub_topic")))
        if found.isEmpty():
            raise PipelineError("no subtopics")
        return found

    # Phase two.

    def jobs(self, subtopics: DataFrame) -> DataFrame:
        """(job_id, main_topic, sub_topic, prompt), with failed subtopics asked again and the share of good ones checked."""
        if self._written("jobs"):
            return self.spark.read.parquet(self.session.path("jobs"))
        g = self.config.generation
        fields = {"MainTopic": F.lit(g.main_topic), "SubTopic": F.col("sub_topic"), "NumPrompts": F.lit(g.num_prompts_per_subtopic), "Count": F.lit(g.num_prompts_per_subtopic)}

        def attempt(rows: DataFrame, number: int) -> DataFrame:
            answers = self._ask("main", "prompts", rows, fields, "sub_idx", f"prompts_{number}")
            return self._stage(f"prompts_{number}", answers.select(F.col("job_id").alias("sub_idx"), strings_of(1)("content").alias("prompts")))

        results = subtopics.join(attempt(subtopics, 0), "sub_idx", "left")
        for number in range(1, g.prompt_retry_attempts + 1):
            failed = results.where("prompts is null").drop("prompts")
            if failed.isEmpty():
                break
            # The first repetition comes at once, the later ones after 2, 4, 8 ... seconds.
            if number > 1:
                self.sleep(2.0 ** (number - 1))
            results = lists.retried(results, attempt(failed, number), "sub_idx", "prompts")
        rate = stats.success_rate(results, F.col("prompts").isNotNull(), g.min_success_rate).first()
        # As many names at most as there are subtopics, which the configuration bounds.
        self.manifest.failed_subtopics = [r.sub_topic for r in results.where("prompts is null").select("sub_topic").collect()]
        self.manifest.prompt_success_rate = float(rate.rate)
        self.manifest.save(self.session.folder)
        self.session.log("prompts", good=rate.good, total=rate.total)
        if not rate.enough:
            raise PipelineError(f"only {rate.good} of {rate.total} subtopics have prompts")
        rows = results.withColumn("main_topic", F.lit(g.main_topic))
        return self._stage("jobs", lists.jobs(rows))

    # Phase three.

    def adopted(self) -> DataFrame | None:
        """Ids of the jobs that were done before the session was taken over."""
        return self.spark.read.parquet(self.session.path(ADOPTED)) if self._written(ADOPTED) else None

    def done(self) -> DataFrame | None:
        """Ids of the jobs with a good pair among those written; failed ones are tried again."""
        good = self.spark.read.parquet(self.session.path("pairs")).where("failure_reason is null").select("job_id") if self._written("pairs") else None
        before = self.adopted()
        return good if before is None else before if good is None else good.union(before)

    def pairs(self, jobs: DataFrame) -> DataFrame:
        """All good pairs so far; the rejected reply is only asked for where the chosen one has passed the gates.

        A row whose call failed has that as its failure reason, with the error, and no reply; it is pending again.
        """
        done = self.done()
        todo = jobs if done is None else lists.pending(jobs, done)
        attempt = 0 if not self._written("pairs") else 1 + (self.spark.read.parquet(self.session.path("pairs")).agg(F.max("attempt")).first()[0] or 0)
        fields = {k: F.col(c) for k, c in (("Prompt", "prompt"), ("MainTopic", "main_topic"), ("SubTopic", "sub_topic"))}
        failed = lambda error: F.concat(F.lit(f"{CALL_FAILED}: "), error)
        chosen = self._ask("main", "chosen", todo, fields, ledger=f"chosen_{attempt}")
        gated = gates.gate(todo.join(chosen, "job_id", "left")).withColumn("failure_reason", F.coalesce(failed(F.col("error")), "failure_reason")).withColumnsRenamed({"duration_ns": "chosen_ns", "wait_ns": "chosen_wait_ns"}).drop("error")
        gated = self._stage("gated", gated)
        if self.config.generation.dataset_mode == "sft":
            rejected = chosen.select("job_id", *(F.lit(None).cast(t).alias(c) for c, t in (("rejected", "string"), ("rejected_reasoning", "string"), ("_error", "string"), ("rejected_ns", "long"), ("rejected_wait_ns", "long")))).limit(0)
        else:
            answers = self._ask("rejected", "rejected", gated.where("failure_reason is null").select(*todo.columns), fields, ledger=f"rejected_{attempt}")
            reasoning = F.col("reasoning_content") if self.config.generation.reasoning_capture_rejected else F.lit(None).cast("string")
            rejected = answers.select("job_id", F.col("content").alias("rejected"), reasoning.alias("rejected_reasoning"), F.col("error").alias("_error"), F.col("duration_ns").alias("rejected_ns"), F.col("wait_ns").alias("rejected_wait_ns"))
        out = gated.join(rejected, "job_id", "left").withColumnsRenamed({"content": "chosen", "reasoning_content": "chosen_reasoning"})
        out = out.withColumn("failure_reason", F.coalesce("failure_reason", failed(F.col("_error")))).withColumn("attempt", F.lit(attempt))
        out.select(*PAIR_COLUMNS).write.mode("append").parquet(self.session.path("pairs"))
        return self.spark.read.parquet(self.session.path("pairs")).where("failure_reason is null").dropDuplicates(["job_id"])

    def judge(self, pairs: DataFrame, stage: str, criteria: tuple[str, ...]) -> DataFrame:
        """Judged pairs by job: both sides of all pairs are asked for in one pass."""
        rows = judging.sides(pairs, ("job_id", "prompt")).withColumn("ask_id", F.col("job_id") * 2 + F.col("k"))
        answers = self._ask("judge", stage, rows, {"Prompt": F.col("prompt"), "StoryText": F.col("reply"), "Reply": F.col("reply"), "Criteria": F.lit(", ".join(criteria))}, "ask_id").where("error is null")
        answered = self._stage(f"{stage}_replies", answers.select(F.expr("job_id div 2").alias("job_id"), F.when(F.col("job_id") % 2 == 0, "chosen").otherwise("rejected").alias("side"), F.col("content").alias("response")))
        return judging.judged(answered, prefer="object")

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs with ``filtered``: whether the judge's scores rule them out; never in the multi-objective mode."""
        f = self.config.judge_filtering
        if not f.enabled or self.config.generation.dataset_mode == "mo-dpo":
            return pairs.withColumn("filtered", F.lit(False))
        scores = self.judge(pairs, "judge_filter", FILTER_CRITERIA).select("job_id", "chosen_score_total", "rejected_score_total")
        keep = judging.passes(F.col("chosen_score_total"), F.col("rejected_score_total"), f.min_chosen_score, f.max_rejected_score, ~is_blank(F.col("rejected")))
        return pairs.join(scores, "job_id", "left").withColumn("filtered", ~keep)

    def records(self, pairs: DataFrame, reasoning: bool = False) -> DataFrame:
        g = self.config.generation
        if g.dataset_mode == "sft":
            if not reasoning:
                return records.sft(pairs, g.sft_format, g.include_topic_columns)
            carried = records.sft(pairs, g.sft_format, g.include_topic_columns, keep=("chosen_reasoning",))
            return records.sft_with_reasoning(carried, "chosen_reasoning").drop("chosen_reasoning")
        if g.dataset_mode == "dpo":
            return records.dpo_with_reasoning(pairs) if reasoning else records.dpo(pairs)
        if g.dataset_mode == "kto":
            return records.kto_with_reasoning(pairs) if reasoning else records.kto(pairs)
        return records.modpo(records.attach_judgement(pairs, self.judge(pairs, "judge", CRITERIA)))

    def _log_jobs(self, everything: DataFrame) -> None:
        """A log line for each attempt at a job, as a table of JSON lines beside the session's log."""
        ms = lambda c: F.expr(f"coalesce({c}, 0) div 1000000")
        caught = F.create_map(*(F.lit(x) for pair in ((gates.INCOMPLETE, "incomplete output"), (gates.REFUSED, "refusal"), (gates.UNEXPECTED, "bad finish_reason"), (gates.EXHAUSTED, "bad finish_reason: nothing but reasoning")) for x in pair))
        good = F.col("failure_reason").isNull()
        msg = F.when(good, F.lit("job done")).otherwise(F.coalesce(F.try_element_at(caught, F.col("failure_reason")), F.col("failure_reason")))
        lines = everything.select(F.when(good, "INFO").otherwise("WARN").alias("level"), msg.alias("msg"), "job_id", ms("chosen_ns").alias("chosen_ms"), ms("rejected_ns").alias("rejected_ms"), (ms("chosen_ns") + ms("rejected_ns")).alias("total_ms"), (ms("chosen_wait_ns") + ms("rejected_wait_ns")).alias("rate_limit_wait_ms"))
        JsonLines(self.session.path("session_jobs"), overwrite=True).write(lines)

    def run(self) -> dict:
        """All phases; the session's statistics."""
        g, began = self.config.generation, time.monotonic()
        self.manifest.save(self.session.folder)
        self.session.log("session begins", mode=g.dataset_mode)
        subtopics = self.subtopics()
        self.manifest.phase = "prompts"
        self.manifest.save(self.session.folder)
        jobs = self.jobs(subtopics)
        self.manifest.phase = "pairs"
        self.manifest.save(self.session.folder)
        judged = self._stage("kept", self.filtered(self.pairs(jobs)))
        kept = judged.where("not filtered")
        # The session is not complete: a dataset that a run before has left is made again.
        JsonLines(self.session.path("dataset.jsonl"), overwrite=True, omit_zero=("chosen_score_total", "rejected_score_total", "preference_margin") if g.dataset_mode == "mo-dpo" else ()).write(self.records(kept), adopted_lines(self.spark, self.session, "dataset.jsonl"))
        if g.enable_reasoning_capture and g.dataset_mode != "mo-dpo":
            JsonLines(self.session.path("dataset_reasoning.jsonl"), overwrite=True).write(self.records(kept, reasoning=True), adopted_lines(self.spark, self.session, "dataset_reasoning.jsonl"))
        everything = self.spark.read.option("mergeSchema", True).parquet(self.session.path("pairs"))
        self._log_jobs(everything)
        spent = F.coalesce(F.col("chosen_ns"), F.lit(0)) + F.coalesce(F.col("rejected_ns"), F.lit(0))
        last = everything.groupBy("job_id").agg(F.min("failure_reason").alias("any_failure"), F.max(F.col("failure_reason").isNull()).alias("good"), F.max_by(spent, F.col("failure_reason").isNull()).alias("duration_ns"))
        outcome = last.join(judged.select("job_id", "filtered"), "job_id", "left").select(F.when(~F.col("good"), F.col("any_failure")).alias("failure_reason"), "filtered", "duration_ns")
        if (before := self.adopted()) is not None:
            outcome = outcome.union(before.select(F.lit(None).cast("string"), F.lit(False), F.lit(0).cast("long")))
        self.manifest.stats = stats.session_stats(outcome).first().asDict()
        self.manifest.phase = "complete"
        self.manifest.save(self.session.folder)
        s = self.manifest.stats
        self.session.log("session complete", duration=int((time.monotonic() - began) * 1e9), total_prompts=s["total"], successful=s["success"], failed=s["failure"])
        return s
