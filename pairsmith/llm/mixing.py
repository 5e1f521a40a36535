"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a number of copies: the whole part of its source's rate plus a fraction that is rounded. Fractions
are rounded in pairs: word mass moves from one document of the pair to the other, in a random direction with the
probabilities that keep both expectations, until one fraction is 0 or 1. The other goes on as the residual. Groups of a
bounded number of documents are folded so, then their residuals, level by level: a reduction tree. As each move keeps
the words of its pair, a source's words stay at their target up to its last residual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, numbered_copies, numbered_rows

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
FOLD_ROWS = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    # A run begins where white space or the start of the text is followed by another character.
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of their code points, null last, weigh ``weights`` in turn. A target is the least of ``most`` times the
    source's size and weight x level, with the level at which targets add up to ``share`` of all sizes: what repeated
    resharing of the excess by weight comes to. There is a row for each source, so the windows here are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # The level that holds is the first one below the caps that remain.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(Window.partitionBy())["level"]
    return rows.withColumn("final", level).select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("w")), F.col("cap")).cast("double").alias("target"))


def _uniform(*columns: F.Column) -> F.Column:
    """In [0, 1), from a hash of the columns: reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _fold(units: F.Column, seed: int, level: int) -> F.Column:
    """Round all but one of an array of (p, size, row) structs: a struct of ``done`` (p now 0 or 1) and the residual ``left``."""
    unit_type = "struct<p:double,size:double,row:struct<doc_id:bigint,size:bigint,source:string,i:bigint>>"
    none = F.lit(None).cast(unit_type)

    def step(state: F.Column, x: F.Column) -> F.Column:
        a, b = state["left"], x
        mass_a, mass_b = a["p"] * a["size"], b["p"] * b["size"]
        up = F.least((F.lit(1.0) - a["p"]) * a["size"], mass_b)  # the most that can go from b to a
        down = F.least(mass_a, (F.lit(1.0) - b["p"]) * b["size"])  # and from a to b
        to_a = _uniform(F.lit(seed), F.lit(level), a["row"]["doc_id"], a["row"]["i"], b["row"]["doc_id"], b["row"]["i"], a["row"]["source"]) * (up + down) < down
        move = F.when(to_a, up).otherwise(-down)
        a_full = to_a & ((F.lit(1.0) - a["p"]) * a["size"] <= mass_b)
        a_empty = ~to_a & (mass_a <= (F.lit(1.0) - b["p"]) * b["size"])
        p_a = F.when(a_full, 1.0).when(a_empty, 0.0).otherwise(a["p"] + move / a["size"])
        p_b = b["p"] - move / b["size"]
        a_done = a_full | a_empty
        p_b = F.when(~a_done, F.when(to_a, 0.0).otherwise(1.0)).otherwise(F.least(F.greatest(p_b, F.lit(0.0)), F.lit(1.0)))
        new_a = F.struct(p_a.alias("p"), a["size"].alias("size"), a["row"].alias("row")).cast(unit_type)
        new_b = F.struct(p_b.alias("p"), b["size"].alias("size"), b["row"].alias("row")).cast(unit_type)
        first = a.isNull()
        done = F.when(first, state["done"]).otherwise(F.concat(state["done"], F.array(F.when(a_done, new_a).otherwise(new_b))))
        left = F.when(first, b.cast(unit_type)).otherwise(F.when(a_done, new_b).otherwise(new_a))
        return F.struct(done.alias("done"), left.alias("left"))

    start = F.struct(F.array().cast(f"array<{unit_type}>").alias("done"), none.alias("left"))
    return F.aggregate(units, start, step)


def copies(units: DataFrame, seed: int = 29, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(doc_id, size, source, i, copies) from (doc_id, size, source, i, rate): rates rounded to whole copies."""
    row = F.struct("doc_id", "size", "source", "i")
    units = units.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole"))
    fixed = units.where("p = 0 or size = 0").select("doc_id", "size", "source", "i", F.col("whole").cast("long").alias("copies"))
    open_units = units.where("p > 0 and size > 0").select("source", "whole", F.struct("p", F.col("size").cast("double").alias("size"), row.alias("row")).alias("u"))
    results, level = [fixed], 0
    largest = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while largest > 0:
        groups = -(-largest // fold_rows)
        # Sources smaller than the largest fill fewer of the groups; all fold about fold_rows units or fewer.
        bucket = F.pmod(F.xxhash64(F.lit(seed + level), "u.row"), F.lit(groups))
        packed = open_units.groupBy("source", "whole", bucket.alias("g")).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed - 1 - level), "u.row").alias("o"), "u"))).alias("us"))
        folded = checkpoint(packed.select("source", "whole", _fold(F.transform("us", lambda x: x["u"]), seed, level).alias("f")))
        done = folded.select("whole", F.explode("f.done").alias("u"))
        results.append(done.select("u.row.*", (F.col("whole") + F.round("u.p")).cast("long").alias("copies")))
        open_units = folded.where("f.left is not null").select("source", "whole", F.col("f.left").alias("u"))
        # The last residual of a source goes either way with its own probability.
        if groups == 1:
            last = open_units.select("u.row.*", (F.col("whole") + (_uniform(F.lit(seed), F.lit("last"), "u.row.doc_id", "u.row.source") < F.col("u.p")).cast("long")).cast("long").alias("copies"))
            results.append(last)
            break
        largest, level = groups, level + 1
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 29) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copies`` for every row of ``docs``.

    Size is the number of words; a null or empty text has none, and its document is taken with the whole part of its
    source's rate, however long or short others are. Copies are the whole number below or above the rate, target / source_size, so none exceeds 3. Equal
    rows are counted and told apart by a running number; null sources form a source of their own, the last. A source
    without words has the target 0. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    counted = checkpoint(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = checkpoint(source_targets(sizes, weights))
    # A join on the source would send a hot source's rows to one task; a row for each source is small while there are few.
    few = targets.count() <= 100_000
    rates = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_COPIES)))).otherwise(F.lit(0.0))).withColumnRenamed("source", "_source")
    units = numbered_copies(counted)
    side = F.broadcast(rates) if few else rates
    joined = units.join(side, units["source"].eqNullSafe(side["_source"]) if not few else units["source"].eqNullSafe(rates["_source"]))
    rounded = copies(joined.select("doc_id", "size", "source", "i", "rate"), seed)
    out = rounded.join(F.broadcast(rates) if few else rates, rounded["source"].eqNullSafe(rates["_source"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "i")


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 29) -> DataFrame:
    """``docs`` with every row repeated as often as ``mix`` takes it; its columns stay as they are, whatever their names.

    Rows without words (null, empty or blank texts) are repeated by their source's rate too, cut to a whole number. Rows that agree in doc_id,
    source and number of words are told apart by a running number; a null doc_id or source is a value like others. Texts may have
    any length; an empty table stays empty.
    """
    chosen = mix(docs, weights, seed).where("copies > 0")
    repeated = not chosen.where("i > 1").isEmpty()
    named = lambda c, zero: (F.coalesce(c, F.lit(zero)), c.isNull())
    doc_id, source, keys = F.col("doc_id").cast("long"), F.col("source").cast("string"), ["_d", "_du", "_s", "_su", "_w"]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *(c.alias(k) for c, k in zip((*named(doc_id, 0), *named(source, ""), word_count(F.col("text").cast("string"))), keys, strict=True)))
    rows = numbered_rows(rows, keys, "_i") if repeated else rows.withColumn("_i", F.lit(1).cast("long"))
    taken = chosen.select(*(c.alias(k) for c, k in zip((*named(F.col("doc_id"), 0), *named(F.col("source"), ""), F.col("size")), keys, strict=True)), F.col("i").alias("_i"), F.col("copies").alias("_copies"))
    joined = rows.join(taken, [*keys, "_i"]).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    return joined.select("_row.*")
