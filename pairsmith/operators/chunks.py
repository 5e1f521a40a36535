"""Assembly of completions that arrive as server-sent events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "id string, model string, created bigint, choices array<struct<delta:struct<content:string,reasoning_content:string>,finish_reason:string>>"
DONE = "[DONE]"


def parse_events(lines: DataFrame, keep_noise: bool = False) -> DataFrame:
    """(request_id, seq, id, model, created, content, reasoning, finish_reason, done) from (request_id, seq, line).

    Blank lines, lines without ``data: `` and bad JSON are skipped, or give rows of nulls with ``keep_noise``.
    """
    data = F.when(F.startswith("line", F.lit("data: ")), F.substring(F.col("line"), F.lit(7), F.char_length("line")))
    rows = lines.withColumn("data", F.coalesce(F.trim(data), F.lit("")))
    done = F.col("data") == DONE
    event = F.struct(done.alias("done"), F.from_json(F.when(~F.col("data").isin(DONE, ""), F.col("data")), EVENT).alias("e"))
    # A line is parsed once: noise goes by what was made of it, as an empty list, not by a filter that would parse it again.
    kept = F.array(event) if keep_noise else F.filter(F.array(event), lambda x: x["done"] | x["e"]["choices"].isNotNull())
    rows = rows.select("request_id", "seq", F.explode(kept).alias("x")).select("request_id", "seq", "x.done", "x.e")
    choice = F.get("e.choices", F.lit(0))
    return rows.select("request_id", "seq", "e.id", "e.model", "e.created", choice["delta"]["content"].alias("content"), choice["delta"]["reasoning_content"].alias("reasoning"), choice["finish_reason"].alias("finish_reason"), "done")


def assemble(events: DataFrame) -> DataFrame:
    """One completion for each request: pieces in order, up to the end mark; the first id, the last finish reason that is given.

    Rows come together by request in one aggregation, and a completion is of bounded length; requests spread over all partitions.
    """
    piece = F.struct("seq", "done", "id", "model", "created", "content", "reasoning", "finish_reason")
    whole = events.groupBy("request_id").agg(F.sort_array(F.collect_list(piece)).alias("all"), F.min(F.when(F.col("done"), F.col("seq"))).alias("end"))
    before = F.when(F.col("end").isNull(), F.col("all")).otherwise(F.filter("all", lambda p: p["seq"] < F.col("end")))
    live = whole.select("request_id", before.alias("live"), F.col("end").isNotNull().alias("done_seen")).where(F.size("live") > 0)
    first = lambda name: F.get(F.filter(F.col("live")[name], lambda x: x.isNotNull()), F.lit(0)).alias(name)
    given = F.filter(F.col("live")["finish_reason"], lambda x: x.isNotNull() & (x != ""))
    return live.select(
        "request_id", first("id"), first("model"), first("created"), F.array_join(F.col("live")["content"], "").alias("content"),
        F.array_join(F.col("live")["reasoning"], "").alias("reasoning_content"), F.try_element_at(given, F.lit(-1)).alias("finish_reason"), "done_seen",
    )
