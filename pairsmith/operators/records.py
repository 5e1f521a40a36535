"""Training records: supervised (two formats), paired, unpaired and multi-objective, with or without reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.functions.text import combine_reasoning, is_blank, utrim

TURN = "struct<from:string,value:string>"
SCORES = "map<string,struct<score:int,reasoning:string>>"
ALPACA_SCHEMA = "main_topic string, sub_topic string, instruction string, input string, output string, system string, history array<array<string>>"
SHAREGPT_SCHEMA = f"main_topic string, sub_topic string, conversations array<{TURN}>"
SFT_SCHEMA = f"{ALPACA_SCHEMA}, conversations array<{TURN}>"
DPO_SCHEMA = "prompt string, chosen string, rejected string"
KTO_SCHEMA = "prompt string, completion string, label boolean"
MODPO_SCHEMA = f"main_topic string, sub_topic string, prompt string, chosen string, rejected string, chosen_scores {SCORES}, rejected_scores {SCORES}, chosen_score_total double, rejected_score_total double, preference_margin double"

# The roles of a turn's speaker.
HUMAN, ASSISTANT = ("human", "user"), ("gpt", "assistant")


def turn(role: str, value: Column) -> Column:
    return F.struct(F.lit(role).alias("from"), value.alias("value"))


def sft(pairs: DataFrame, style: str = "sharegpt", topics: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prompt and chosen reply as a conversation (``sharegpt``) or as instruction and output (``alpaca``), with the columns ``keep`` besides."""
    lead = [F.col("main_topic"), F.col("sub_topic")] if topics else [F.lit(None).cast("string").alias("main_topic"), F.lit(None).cast("string").alias("sub_topic")]
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    if style == "alpaca":
        rest = [F.col("prompt").alias("instruction"), none("input"), F.col("chosen").alias("output"), none("system"), none("history", "array<array<string>>"), none("conversations", f"array<{TURN}>")]
    elif style == "sharegpt":
        rest = [none("instruction"), none("input"), none("output"), none("system"), none("history", "array<array<string>>"), F.array(turn("human", F.col("prompt")), turn("gpt", F.col("chosen"))).alias("conversations")]
    else:
        raise ValueError(f"unknown style {style}")
    return pairs.select(*lead, *rest, *keep)


def dpo(pairs: DataFrame) -> DataFrame:
    return pairs.select("prompt", "chosen", "rejected")


def kto(pairs: DataFrame) -> DataFrame:
    """Two rows of each pair: the chosen reply as good, the rejected one as bad, in this order; no shuffle."""
    both = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    return pairs.select("prompt", F.inline(both))


def modpo(pairs: DataFrame) -> DataFrame:
    """Pairs with both sides' scores; rows that were not judged have nulls."""
    return pairs.select("main_topic", "sub_topic", "prompt", "chosen", "rejected", "chosen_scores", "rejected_scores", "chosen_score_total", "rejected_score_total", "preference_margin")


def attach_judgement(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """Each pair with its judgement, if it has one: at most one for each job."""
    return pairs.join(judged, "job_id", "left")


def _last_assistant(turns: Column) -> Column:
    """The index of the last turn of the assistant, -1 without one."""
    at = F.filter(F.transform(turns, lambda t, i: F.when(t["from"].isin(*ASSISTANT), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(at), F.lit(-1))


def reasoning_into_turns(turns: Column, reasoning: Column) -> Column:
    """The reasoning before the assistant's last turn; where there is none, a turn of its own at the end."""
    last = _last_assistant(turns)
    merged = F.transform(turns, lambda t, i: F.struct(t["from"].alias("from"), F.when(i == last, combine_reasoning(reasoning, t["value"])).otherwise(t["value"]).alias("value")))
    added = F.concat(turns, F.array(turn("gpt", combine_reasoning(reasoning, F.lit("")))))
    return F.when(F.coalesce(reasoning, F.lit("")) == "", turns).when(last >= 0, merged).otherwise(added)


def sft_with_reasoning(records: DataFrame, reasoning: str = "reasoning") -> DataFrame:
    """Supervised records with the reasoning in the reply, whichever style they have."""
    r = F.col(reasoning)
    talks = F.size(F.coalesce("conversations", F.array().cast(f"array<{TURN}>"))) > 0
    return records.withColumn("output", F.when(talks, F.col("output")).otherwise(combine_reasoning(r, F.coalesce("output", F.lit(""))))).withColumn("conversations", F.when(talks, reasoning_into_turns(F.col("conversations"), r)).otherwise(F.col("conversations")))


def dpo_with_reasoning(pairs: DataFrame) -> DataFrame:
    return pairs.select("prompt", combine_reasoning(F.col("chosen_reasoning"), F.col("chosen")).alias("chosen"), combine_reasoning(F.col("rejected_reasoning"), F.col("rejected")).alias("rejected"))


def kto_with_reasoning(pairs: DataFrame) -> DataFrame:
    return kto(dpo_with_reasoning(pairs))


def prompt_and_chosen(records: DataFrame, style: str) -> DataFrame:
    """``records`` with ``prompt`` and ``chosen``; null where a record has none.

    alpaca: trimmed instruction and input, a blank line between; sharegpt: the first turn of the human that is not blank, trimmed,
    and the assistant's last turn as it is, also if an earlier one has more.
    """
    if style == "alpaca":
        instruction, more = utrim(F.coalesce("instruction", F.lit(""))), F.coalesce("input", F.lit(""))
        prompt = F.when(more == "", instruction).when(instruction == "", utrim(more)).otherwise(F.concat(instruction, F.lit("\n\n"), utrim(more)))
        chosen = F.coalesce("output", F.lit(""))
    elif style == "sharegpt":
        turns = F.coalesce("conversations", F.array().cast(f"array<{TURN}>"))
        prompt = utrim(F.get(F.filter(turns, lambda t: F.lower(utrim(t["from"])).isin(*HUMAN) & ~is_blank(t["value"])), F.lit(0))["value"])
        chosen = F.try_element_at(F.filter(turns, lambda t: F.lower(utrim(t["from"])).isin(*ASSISTANT)), F.lit(-1))["value"]
    else:
        raise ValueError(f"unknown style {style}")
    return records.withColumn("prompt", F.nullif(prompt, F.lit(""))).withColumn("chosen", F.when(~is_blank(chosen), chosen))


def conversation_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, conversations) from (conv_id, turn, role, text) rows: each conversation's turns in order."""
    name = F.when(F.col("role") == "user", F.lit("human")).when(F.col("role") == "assistant", F.lit("gpt")).otherwise(F.col("role"))
    turns = F.sort_array(F.collect_list(F.struct("turn", name.alias("from"), F.col("text").alias("value"))))
    return messages.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))
