"""Checks of names and settings as columns: a table of experiments is checked as a whole, without a loop on the driver.

The bounds are those of ``sources.config``, which checks one configuration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.functions.naming import SESSION_NAME
from pairsmith.functions.text import byte_length, has_control_characters, is_blank
from pairsmith.sources.config import MAX_MODEL, MAX_RETRIES, MAX_TEMPLATE, MAX_TOPIC, MODES, STYLES


def session_name_ok(name: Column) -> Column:
    """Whether a session may have that name: of the right form, without separators or steps upwards."""
    form = SESSION_NAME.pattern.replace(r"\Z", r"\z")
    return F.coalesce(name.rlike(f"^{form}") & ~name.contains("/") & ~name.contains("\\") & ~name.contains(".."), F.lit(False))


def url_ok(url: Column) -> Column:
    """http or https with a host."""
    host = F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\[\]@]*)", 1)
    return F.coalesce(host != "", F.lit(False))


def _topic_ok(topic: Column) -> Column:
    return ~is_blank(topic) & (byte_length(topic) <= MAX_TOPIC) & ~has_control_characters(topic)


def _first(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that does not hold, null if all do; what is null does not hold."""
    return reduce(lambda chain, r: chain.when(~F.coalesce(r[0], F.lit(False)), F.lit(r[1])), rules[1:], F.when(~F.coalesce(rules[0][0], F.lit(False)), F.lit(rules[0][1])))


def run_problem(limits: bool = True) -> Column:
    """What is wrong with a row of main_topic, num_subtopics, num_prompts_per_subtopic, concurrency, over_generation_buffer, min_success_rate,
    prompt_retry_attempts, dataset_mode and sft_format: the first problem, or null. Without ``limits`` numbers have no upper bounds."""
    most = lambda n: n if limits else 10**9
    within = lambda c, low, high: F.col(c).between(low, high)
    return _first(
        [
            (_topic_ok(F.col("main_topic")), "main_topic"),
            (within("num_subtopics", 1, most(10_000)), "num_subtopics"),
            (within("num_prompts_per_subtopic", 1, most(10_000)), "num_prompts_per_subtopic"),
            (within("concurrency", 1, most(1024)), "concurrency"),
            (within("over_generation_buffer", 0, 1), "over_generation_buffer"),
            (within("min_success_rate", 0, 1), "min_success_rate"),
            (within("prompt_retry_attempts", 0, most(MAX_RETRIES)), "prompt_retry_attempts"),
            (F.col("dataset_mode").isin(*MODES), "dataset_mode"),
            (F.col("sft_format").isin(*STYLES), "sft_format"),
        ]
    )


def model_problem() -> Column:
    """What is wrong with a row of base_url, model_name, temperature, structure_temperature, top_p, max_output_tokens, context_size (0: not known) and rate_limit_per_minute."""
    within = lambda c, low, high: F.col(c).between(low, high)
    name = F.col("model_name")
    return _first(
        [
            (url_ok(F.col("base_url")), "base_url"),
            (~is_blank(name) & (byte_length(name) <= MAX_MODEL) & ~has_control_characters(name), "model_name"),
            (within("temperature", 0, 2), "temperature"),
            (within("structure_temperature", 0, 2), "structure_temperature"),
            (within("top_p", 0, 1), "top_p"),
            (F.col("max_output_tokens") >= 1, "max_output_tokens"),
            ((F.col("context_size") == 0) | (F.col("max_output_tokens") <= F.col("context_size")), "max_output_tokens is beyond the context"),
            (F.col("rate_limit_per_minute") >= 1, "rate_limit_per_minute"),
        ]
    )


def template_size_ok(text: Column) -> Column:
    return F.coalesce(byte_length(text) <= MAX_TEMPLATE, F.lit(True))


def checked(rows: DataFrame, problem: Column, name: str = "problem") -> DataFrame:
    """``rows`` with their first problem; an experiment without one can be run."""
    return rows.withColumn(name, problem)
