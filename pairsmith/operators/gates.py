"""Quality gates on completions: the first that fails names the reason, and the row goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.functions.text import byte_length, contains_any, first_of, is_blank, utrim

# A chosen reply that contains one of these, case ignored, is a refusal.
REFUSALS = (
    "i'm sorry, but i can't help with that",
    "i cannot help with that",
    "i can't assist with that",
    "i'm unable to help with that",
    "i apologize, but i cannot",
    "i'm not able to assist",
    "i cannot provide",
    "i cannot generate",
    "i'm sorry, i cannot",
    "i'm sorry, but i cannot",
    "as an ai",
    "i don't feel comfortable",
)
TERMINAL = (".", "!", "?", '"', "'")
LEAST_REPLY, LEAST_COMPLETE = 50, 100
EXHAUSTED, UNEXPECTED, REFUSED, INCOMPLETE = "token_exhaustion", "finish_reason", "refusal", "incomplete"


def finish_ok(finish: Column, has_reasoning: Column, content_bytes: Column) -> Column:
    """Stopped, cut at the limit with some content, or no reason given."""
    given = F.coalesce(finish, F.lit(""))
    return given.isin("", "stop") | ((given == "length") & ~(has_reasoning & (content_bytes == 0)))


def straight(text: Column) -> Column:
    """The text with straight apostrophes for curly ones: the list of refusals has straight ones only."""
    return F.translate(text, "\u2018\u2019\u02bc", "'''")


def is_refusal(text: Column, has_reasoning: Column, finish: Column) -> Column:
    short = byte_length(utrim(text)) < LEAST_REPLY
    excused = has_reasoning & (F.coalesce(finish, F.lit("")) == "length")
    return F.when(short, ~excused).otherwise(contains_any(F.lower(text), REFUSALS))


def refusal_reason(text: Column) -> Column:
    found = first_of(F.lower(text), REFUSALS)
    return F.when(byte_length(utrim(text)) < LEAST_REPLY, F.lit("too short")).otherwise(F.coalesce(found, F.lit("unknown")))


def is_incomplete(text: Column, finish: Column) -> Column:
    """Fewer than 100 bytes, or stopped without closing punctuation; the byte length is tested first."""
    trimmed = utrim(text)
    limit = F.coalesce(finish, F.lit("")) == "length"
    return F.when(byte_length(trimmed) < LEAST_COMPLETE, True).when(limit, False).otherwise(~F.right(trimmed, F.lit(1)).isin(*TERMINAL))


def incomplete_reason(text: Column) -> Column:
    trimmed = utrim(text)
    # The last word without its closing marks; a few letters of it tell all that is asked.
    last = F.regexp_extract(F.right(F.rtrim(trimmed, F.lit(".,;:!?\"'")), F.lit(16)), r"(\S*)\z", 1)
    return F.when(byte_length(trimmed) < LEAST_COMPLETE, F.lit("too short")).when((byte_length(last) > 2) & last.rlike("[a-z]$"), F.lit("mid-sentence")).otherwise(F.lit("no closing punctuation"))


def failure_reason(content: Column, reasoning: Column, finish: Column, curly: bool = False) -> Column:
    """The first gate that fails, in the order exhaustion, finish reason, refusal, incompleteness; null if none does.

    With ``curly`` refusals with curly apostrophes are told too.
    """
    text = F.coalesce(content, F.lit(""))
    thought = ~is_blank(reasoning)
    exhausted = is_blank(text) & thought & (F.coalesce(finish, F.lit("")) == "length")
    return (
        F.when(exhausted, F.lit(EXHAUSTED))
        .when(~finish_ok(finish, thought, byte_length(text)), F.lit(UNEXPECTED))
        .when(is_refusal(text, thought, finish) | (is_refusal(straight(text), thought, finish) if curly else F.lit(False)), F.lit(REFUSED))
        .when(is_incomplete(text, finish), F.lit(INCOMPLETE))
    )


def gate(completions: DataFrame, content: str = "content", reasoning: str = "reasoning_content", finish: str = "finish_reason", curly: bool = False) -> DataFrame:
    """``completions`` with ``failure_reason``; what passes has none."""
    return completions.withColumn("failure_reason", failure_reason(F.col(content), F.col(reasoning), F.col(finish), curly))
