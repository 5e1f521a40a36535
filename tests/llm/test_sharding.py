import zlib
from collections import defaultdict

from pairsmith.llm.sharding import assign_shards, write_shards

SCHEMA = "doc_id long, text string, size string, shard string, slot string"


def verify(rows, out, shards):
    def crc(t):
        return zlib.crc32((t or "").encode())

    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == sorted(((d, len((t or "").encode()) + 16, crc(t)) for d, t in rows), key=str)
    slots = defaultdict(list)
    for r in out:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = assign_shards(docs, bucket_rows=64).collect()
    verify(rows, out, 40)
    again = assign_shards(docs, bucket_rows=64).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    # Neighbours in the input do not stay together.
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.shard))]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < 20


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (None, "a"), *[(3, "same")] * 200, (4, "é" * 100_000)]
    frame = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)
    verify(rows, assign_shards(frame, bucket_rows=16).collect(), 40)
    assert assign_shards(frame.limit(0)).count() == 0


def test_files(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(101)] + [(7, "text 7"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write_shards(docs, f"{tmp_path}/out", shards=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [20, 20, 21, 21, 21]
    clash = docs.selectExpr("doc_id", "text", "'a' as shard", "1 as _k")
    write_shards(clash, f"{tmp_path}/clash", shards=3)
    assert sorted(r["count"] for r in spark.read.parquet(f"{tmp_path}/clash").where("shard = 'a' and _k = 1").groupBy("_shard").count().collect()) == [34, 34, 35]


def test_the_order_is_the_same_for_any_number_of_shuffle_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = sorted(map(tuple, assign_shards(docs, bucket_rows=16).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = sorted(map(tuple, assign_shards(docs.repartition(5), bucket_rows=16).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again
