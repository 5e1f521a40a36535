"""Judge scores: means, margins and the threshold filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsmith.functions.jsonkit import judge_udf
from pairsmith.functions.text import is_blank


def mean_score(scores: Column) -> Column:
    """The mean of a map's scores, 0 for an empty one, null for null."""
    total = F.aggregate(F.map_values(scores), F.lit(0).cast("long"), lambda a, s: a + s["score"])
    return F.when(F.size(scores) == 0, F.lit(0.0)).when(scores.isNotNull(), total / F.size(scores))


def sides(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Two rows of each pair, (keys, side, k, reply), as both sides are asked about in one pass; no shuffle. Blank replies are not asked about."""
    both = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(k).alias("k"), F.col(s).alias("reply")) for k, s in enumerate(("chosen", "rejected"))))
    return pairs.select(*keys, F.inline(both)).where(~is_blank(F.col("reply")))


def judged(replies: DataFrame, prefer: str = "array") -> DataFrame:
    """(job_id, scores, totals and margin of both sides) from (job_id, side, response) rows; a reply that cannot be read gives nulls."""
    parsed = replies.select("job_id", "side", judge_udf(prefer)("response").alias("j")).select("job_id", "side", F.col("j.scores").alias("scores"))
    side = lambda name: F.max_by("scores", F.when(F.col("side") == name, 1).otherwise(0))
    both = parsed.groupBy("job_id").agg(*(F.when(F.max(F.col("side") == s), side(s)).alias(f"{s}_scores") for s in ("chosen", "rejected")))
    totals = both.withColumns({f"{s}_score_total": mean_score(F.col(f"{s}_scores")) for s in ("chosen", "rejected")})
    return totals.withColumn("preference_margin", F.col("chosen_score_total") - F.col("rejected_score_total"))


def passes(chosen: Column, rejected: Column, least_chosen: float, most_rejected: float, has_rejected: Column | None = None) -> Column:
    """Drop a pair whose chosen reply scores too low or whose rejected one too high; what was not judged stays."""
    low = chosen < least_chosen
    high = rejected > most_rejected
    if has_rejected is not None:
        high = high & has_rejected
    return ~F.coalesce(low | F.coalesce(high, F.lit(False)), F.lit(False))
