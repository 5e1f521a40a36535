"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash; pass two permutes each bucket with Spark's
``shuffle`` (a Fisher-Yates shuffle) and, as the buckets' partitions depend on the number of rows alone, gives the same order on any cluster. It gives every row its place in the whole order. Rows go to shards in turn, so
that shards' counts differ by one at most (the law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, numbered_copies, numbered_rows

BUCKET_ROWS = 20_000
#: Partitions of buckets at most.
PARTITIONS = 20_000


def shuffled_order(rows: DataFrame, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``place``: their position from 0, without gaps, in a seeded random order.

    Rows that are equal in all columns are interchangeable; they are counted first and told apart by a running number,
    so that they too scatter over all buckets.
    """
    columns = rows.columns
    counted = checkpoint(numbered_copies(rows.groupBy(*columns).agg(F.count("*").alias("_n")), "_n", "_i"))
    buckets = max(1, -(-counted.count() // bucket_rows))
    scattered = counted.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *columns, "_i"), F.lit(buckets)))
    sizes = scattered.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    # One row for each bucket: a window over them all is small.
    starts = sizes.select("_bucket", (F.sum("_rows").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("_start"))
    starts = starts.na.fill(0, ["_start"])
    # shuffle() draws from a generator of its partition, which here depends on nothing but the number of buckets.
    packed = scattered.repartition(min(buckets, PARTITIONS), "_bucket").groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct(*columns, "_i"))).alias("_rows"))
    packed = packed.sortWithinPartitions("_bucket").select("_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    # Written down at once.
    placed = packed.join(starts, "_bucket").select(F.col("_start"), F.posexplode("_rows").alias("_at", "_row"))
    return checkpoint(placed.select(*(F.col("_row")[c].alias(c) for c in columns), (F.col("_start") + F.col("_at")).alias("place")))


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Size: UTF-8 bytes of the text, none where it is null, plus 16. The law is ``rows``: the shards' counts are at most one
    apart; slot counts from 0 in each shard without gaps. The CRC of a null text is that of an empty one. Rows may repeat and
    doc_id may be null; each row gets a place of its own. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    placed = shuffled_order(rows, seed, bucket_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17) -> None:
    """Write ``docs`` as one folder ``shard=k`` for each shard, rows in the order of their slots, all columns as they are.

    Where there is a column ``shard`` already, the folders are named ``_shard=k``, and so on. The places come from ``assign_shards``; rows that agree in doc_id, size and CRC take their places in any order.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    text = F.coalesce(F.col("text"), F.lit(""))
    keys, doc_id = ["_d", "_u", "_size", "_crc"], F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(doc_id, F.lit(0)).alias("_d"), doc_id.isNull().alias("_u"), (F.octet_length(text).cast("long") + 16).alias("_size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("_crc"))
    places = assign_shards(docs, shards, seed).select(F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_u"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", F.col("slot").alias("_slot"))
    joined = numbered_rows(rows, keys, "_k").join(numbered_rows(places, keys, "_k"), [*keys, "_k"])
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "_slot").select("_row.*", F.col("shard").alias(name)).write.mode("error").partitionBy(name).parquet(path)
