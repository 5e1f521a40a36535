"""Shared helpers: reliable checkpoints, table access and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch between the JVM and Python: a bound on memory that long texts do not move.
BATCH_BYTES = 5 << 20


def small_batches(df: DataFrame) -> None:
    """From now on the session hands rows to Python in batches of at most about BATCH_BYTES, not 10,000 rows of any length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session in one process may go without: it gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _free(spark: SparkSession) -> None:
    # Shuffle files of what came before go once the driver's objects for them do.
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    _shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _free(df.sparkSession)
    return out


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: for wide tables, of which later steps read some columns."""
    folder = stage_folder(df.sparkSession)
    df.write.parquet(folder)
    _free(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def row_id(*columns: str) -> F.Column:
    """``doc_id``, or a hash of the columns where it is null."""
    return F.coalesce(F.col("doc_id"), F.xxhash64(*columns))


def numbered_copies(counted: DataFrame, n: str = "n", name: str = "i", step: int = 10_000) -> DataFrame:
    """Each row as often as its count says, with a running number from 1 in place of the count; no long list is ever made."""
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {step}"))))
    first, last = F.col("_block") * step + 1, F.least(F.col(n).cast("long"), (F.col("_block") + 1) * step)
    return blocks.withColumn(name, F.explode(F.sequence(first, last))).drop("_block", n)


def numbered_rows(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a running number from 1 among those with equal keys, counted in parts: no task gets all rows of a frequent key.

    They are written first: another evaluation might deal them to other parts.
    """
    parts = staged(rows.withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_many"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_many").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*(F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)), F.col("_part").alias("_p"), "_before")
    own = parts.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.lit(0))).cast("long"))
    same = own["_part"] == before["_p"]
    for j, k in enumerate(keys):
        same = same & own[k].eqNullSafe(before[f"_k{j}"])
    return own.join(before, same).withColumn(name, F.col("_at") + F.col("_before")).select(*rows.columns, name)


#: Rows of a table sent to all tasks at most, and the rows of one key below which it is never split off.
FEW, CALM = 200_000, 1000


def hot_rows(rows: int) -> int:
    """A key of more rows than this, of ``rows`` in all, is a hot one; so there are fewer than FEW of them, whatever the data."""
    return max(CALM, rows // FEW)


def join_unique(big: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """``big`` joined to ``small``, which has one row for each key and in ``n`` the count of big's rows with it; ``rows`` is big's count.

    The rows of hot keys meet a broadcast share of ``small``, below FEW rows by the choice of what is hot; the others are shuffled. No
    task gets all rows of a hot key.
    """
    most = hot_rows(rows)
    hot = small.where(F.col("n") > most).drop("n")
    rest = big.join(small.where(F.col("n") <= most).drop("n"), key)
    return rest if hot.isEmpty() else big.join(F.broadcast(hot), key).unionByName(rest)


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """Components of an undirected graph given as (src, dst).

    Alternates the large-star and small-star steps until the edge set no longer changes; every step is a partial
    aggregation for the smallest neighbour and a join on the node that splits hubs, so no neighbourhood is ever held in one row or task.
    Returns (node, component) for every node that has an edge to another one; component is the least node of its own. ``keep`` writes
    what a step has found: ``checkpoint`` runs the last stage of it twice, ``staged`` once.
    """
    current = keep(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        # Stars: every node has one edge to a smaller one at most, and none if it is the smaller one of another.
        ends = current.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(current.select("v", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
        seen = nodes.agg(F.bool_or(F.expr("down > 1 or (down > 0 and up > 0)")).alias("open"), F.sum("down").alias("edges"), F.max(F.col("down") + F.col("up")).alias("most")).first()
        if not seen.open:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        hubs = seen.most > hot_rows(2 * seen.edges)
        near = join_unique(both, keep(least), "u", 2 * seen.edges) if hubs else both.join(least.drop("n"), "u")
        large = near.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large) if hubs else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = join_unique(large, keep(least), "u", 2 * seen.edges) if hubs else large.join(least.drop("n"), "u")
        small, least = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), least.select("u", "m")
        current = keep(small.union(least).distinct())


def stage_folder(spark: SparkSession) -> str:
    """A name for a new folder of written tables in the shared folder."""
    return f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
