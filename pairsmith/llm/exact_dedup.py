"""Exact deduplication by Grace hashing.

Records are scattered by a hash of their normalised text to a bounded number of buckets; the spill files are Spark's shuffle files and, from one
level to the next, a written table, so that a lost executor's share can be made again. Buckets larger than the memory bound are scattered
again under the next hash, level by level, until each fits an open-addressing table, which compares complete contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, checkpoint, join_unique, numbered_copies, small_batches, staged

BUCKET_BYTES = 64 << 20
#: Buckets that one bucket is scattered to at most, and partitions of a level.
FANOUT = 4096


class OpenTable:
    """An open-addressing hash table (linear probing) from complete contents to a running (largest id, count)."""

    def __init__(self, slots: int = 1024) -> None:
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def add(self, h: int, content: bytes, doc_id: int | None, count: int = 1) -> int:
        if 2 * len(self.hashes) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                if doc_id is not None and (self.ids[entry] is None or doc_id > self.ids[entry]):
                    self.ids[entry] = doc_id
                self.counts[entry] += count
                return int(entry)
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.ids.append(doc_id)
        self.counts.append(count)
        return int(entry)


_SPILL = pa.schema([("h", pa.int64()), ("norm", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])
_GROUPS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _normal() -> F.Column:
    """UTF-8 of the text with A-Z, and no other letter, in lower case; a null counts as empty."""
    return F.encode(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "UTF-8")


def _collapse(limit: int):
    """Merge equal records of one input partition, flushing the table whenever it holds ``limit`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, held = OpenTable(), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(merged.hashes, pa.int64()), pa.array(merged.contents, pa.binary()), pa.array(merged.ids, pa.int64()), pa.array(merged.counts, pa.int64())], schema=_SPILL)

        for batch in batches:
            for h, content, doc_id in zip(batch["h"].to_pylist(), batch["norm"].to_pylist(), batch["doc_id"].to_pylist(), strict=True):
                before = len(merged.hashes)
                merged.add(h, content, doc_id)
                held += (len(content) + 100) * (len(merged.hashes) - before)
                if held > limit:
                    yield flush()
                    merged, held = OpenTable(), 0
        if merged.hashes:
            yield flush()

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct content; records arrive sorted by bucket, and one bucket is held at a time."""

    def groups() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(c).hexdigest() for c in merged.contents], pa.string()), pa.array(merged.ids, pa.int64()), pa.array(merged.counts, pa.int64())], schema=_GROUPS)

    merged, current = OpenTable(), None
    for batch in batches:
        for h, bucket, content, doc_id, n in zip(*(batch[c].to_pylist() for c in ("h", "bucket", "norm", "keep_id", "n")), strict=True):
            if bucket != current and merged.hashes:
                yield groups()
                merged = OpenTable()
            current = bucket
            merged.add(h, content, doc_id, n)
    if merged.hashes:
        yield groups()


def content_groups(records: DataFrame, bucket_bytes: int = BUCKET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(text_sha256, keep_id, group_size) for each distinct content of (h, size, norm, doc_id), h being a hash of it."""
    least_tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = checkpoint(records.groupBy("h").agg(F.max("size").alias("b")))
    rest = records.select("h", "norm", "doc_id").mapInArrow(_collapse(bucket_bytes // 4), "h long, norm binary, keep_id long, n long")
    rest, sizes = rest.withColumn("bucket", F.lit(0).cast("long")), sizes.withColumn("bucket", F.lit(0).cast("long"))
    parts, level = [], 0
    while True:
        most = sizes.groupBy("bucket").agg(F.sum("b").alias("b")).agg(F.max("b")).first()[0] or 0
        fan = int(min(fanout, max(1, -(-2 * most // bucket_bytes))))
        # Each level deals by a hash of its own, inside of the buckets of the one before.
        child = (F.col("bucket") * fan + F.pmod(F.xxhash64("h", F.lit(level)), F.lit(fan))).alias("bucket")
        rest, sizes = rest.withColumn("bucket", child), sizes.withColumn("bucket", child)
        # A bucket of one text needs no more than that text and is never split.
        full = checkpoint(sizes.groupBy("bucket").agg(F.sum("b").alias("b"), F.count("*").alias("n")).where(f"b > {bucket_bytes} and n > 1").select("bucket"))
        many = full.count()
        if level == 0:
            rest = rest if not many else staged(rest.repartition(max(fan, least_tasks), "bucket"))
        full = F.broadcast(full) if many <= FEW else full
        fits = rest.join(full, "bucket", "left_anti") if many else rest
        done = fits.repartition(max(fan, least_tasks), "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, "text_sha256 string, keep_id long, group_size long")
        parts.append(done)
        if not many:
            break
        rest, sizes, level = staged(rest.join(full, "bucket", "left_semi")), checkpoint(sizes.join(full, "bucket", "left_semi")), level + 1
    groups = parts[0]
    for more in parts[1:]:
        groups = groups.union(more)
    return groups


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Every row of ``docs`` with the group of its text.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. The row with the largest
    doc_id of a group stays; a null doc_id is below every other, and of rows equal in doc_id and text just one stays.
    A text has to fit a task's memory, a bucket of several texts is split until it does. Returns
    ``doc_id, keep_id, group_size, kept, text_sha256``; an empty table gives none. Other columns of ``docs`` are
    ignored, so their names cannot clash.
    """
    small_batches(docs)
    normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _normal().alias("norm"))
    groups = staged(content_groups(normal.select("doc_id", "norm", F.xxhash64("norm").alias("h"), (F.octet_length("norm") + 100).cast("long").alias("size")), bucket_bytes, fanout))
    digests = staged(normal.select("doc_id", F.sha2("norm", 256).alias("text_sha256")))
    # Rows equal in doc_id and text are interchangeable: they are counted, then told apart by a running number.
    rows = numbered_copies(digests.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    found = join_unique(rows, groups.withColumn("n", F.col("group_size")), "text_sha256", total)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Null and empty texts are one group, of which a row stays. Rows are told apart by doc_id and text; of those equal in both one
    stays, and which one's other columns stay is not defined. An empty table stays empty; a text may have any length that fits a task.
    """
    kept = checkpoint(exact_dedup(docs, bucket_bytes).where("kept").select(F.coalesce("keep_id", F.lit(0)).alias("_d"), F.col("keep_id").isNull().alias("_u"), F.col("text_sha256").alias("_h")))
    doc_id = F.col("doc_id").cast("long")
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(doc_id, F.lit(0)).alias("_d"), doc_id.isNull().alias("_u"), F.sha2(_normal(), 256).alias("_h"))
    found = named.join(kept, ["_d", "_u", "_h"], "left_semi")
    # Copies of a row that stays have its keys; there is one row for each of them where doc_ids tell all rows apart.
    if not docs.groupBy(doc_id).count().where("count > 1").isEmpty():
        found = found.groupBy("_d", "_u", "_h").agg(F.first("_row").alias("_row"))
    return found.select("_row.*")
