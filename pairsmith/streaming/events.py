"""Streams: completions assembled from events as they arrive, first occurrences, windowed counts of an event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairsmith.functions.text import utrim
from pairsmith.operators.chunks import parse_events
from pairsmith.sources.staging import written


def files(spark: SparkSession, path: str, schema: str, kind: str = "json", at_once: int = 100) -> DataFrame:
    """A stream of the files that arrive in a folder, some at a time: the bound is the back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).format(kind).load(path)


ASSEMBLED = "request_id long, id string, model string, created long, content string, reasoning_content string, finish_reason string, done_seen boolean"
_STATE = "id string, model string, created long, named_at long, pieces array<struct<seq:bigint,content:string,reasoning:string,finish:string>>, done long"


def _collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold a request's pieces until all up to its end mark are there, or nothing has come for the timeout; then give one row."""
    name, model, created, named_at, pieces, done = state.get if state.exists else (None, None, None, None, [], None)
    pieces = [tuple(p) for p in pieces]
    for frame in batches:
        for r in frame.sort_values("seq").itertuples():
            if r.done:
                done = r.seq if done is None else min(done, r.seq)
                continue
            if isinstance(r.id, str) and (named_at is None or r.seq < named_at):
                name, model, created, named_at = r.id, r.model, r.created, r.seq
            pieces.append((r.seq, *(x if isinstance(x, str) else "" for x in (r.content, r.reasoning, r.finish_reason))))
    # Lines of a request are numbered without gaps, noise included.
    there = {p[0] for p in pieces if done is not None and p[0] < done}
    complete = bool(there) and len(there) == done - min(there)
    if complete or state.hasTimedOut:
        kept = sorted({p for p in pieces if done is None or p[0] < done})
        finish = [p[3] for p in kept if p[3]]
        state.remove()
        yield pd.DataFrame([(key[0], name, model, created, "".join(p[1] for p in kept), "".join(p[2] for p in kept), finish[-1] if finish else None, done is not None)], columns=[c.split()[0] for c in ASSEMBLED.split(", ")])
    else:
        state.update((name, model, None if created is None else int(created), None if named_at is None else int(named_at), pieces, None if done is None else int(done)))
        state.setTimeoutDuration(600_000)


def assemble_stream(lines: DataFrame) -> DataFrame:
    """One completion for each request from a stream of (request_id, seq, line), given out when its end mark has come."""
    return parse_events(lines, keep_noise=True).groupBy("request_id").applyInPandasWithState(_collect, ASSEMBLED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_seen(items: DataFrame, item: str, at: str, late: str = "1 hour") -> DataFrame:
    """Items that are not equal, trimmed and lower-cased, to one within the watermark: streaming deduplication with bounded state."""
    key = F.lower(utrim(F.col(item)))
    return items.withColumn("_key", key).where(F.col("_key") != "").withWatermark(at, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed(log: DataFrame, at: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and mean values by window and group; rows that come later than the watermark do not count.

    A time without zone is taken as UTC, as watermarks want a moment.
    """
    moment = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    window = F.window("_at", size, slide) if slide else F.window("_at", size)
    return moment.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")


def sessions_of(log: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each group: rows with no longer pause between them than the gap."""
    moment = log.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return moment.groupBy(F.session_window("_at", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


#: A batch with at most as many keys is sent to the tasks that read the table; one with more meets it in a shuffle.
FEW_KEYS = 200_000


def new_keys(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of a batch whose key is not in the table. Of the table only the key is read, and with a small batch none of it is shuffled."""
    seen = table.select(key)
    if batch.count() <= FEW_KEYS:
        seen = seen.join(F.broadcast(batch.select(key)), key, "left_semi")
    return batch.join(seen, key, "left_anti")


def append_once(rows: DataFrame, path: str, key: str, checkpoint: str):
    """A started query that adds the rows of a stream whose key is not yet in the table; a batch that is repeated adds none of them again.

    Rows without a key cannot be told apart: they go in as they are, those of a repeated batch too.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        # Written down: a batch is read for its keys and again for its rows.
        batch = written(batch)
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            new = new_keys(new, spark.read.parquet(path), key)
        new.unionByName(batch.where(F.col(key).isNull())).write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
