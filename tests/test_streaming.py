import json

import pytest
from pyspark.sql import functions as F

from pairsmith.operators.chunks import assemble, parse_events
from pairsmith.streaming import events


def event(content=None, finish=None, reasoning=None):
    return "data: " + json.dumps({"id": "i", "model": "m", "created": 1, "choices": [{"delta": {"content": content, "reasoning_content": reasoning}, "finish_reason": finish}]})


ROWS = [(1, 3, event("b", "stop")), (1, 1, event("a", reasoning="r")), (1, 2, ""), (1, 4, "data: [DONE]"), (1, 5, event("late")), (1, 0, "data: {bad"), (2, 1, event("only", "length")), (2, 2, "data: [DONE]")]


def test_assembly(spark):
    frame = spark.createDataFrame([*ROWS, (3, 1, event("open"))], "request_id long, seq long, line string")
    got = {r.request_id: (r.content, r.reasoning_content, r.finish_reason, r.done_seen) for r in assemble(parse_events(frame)).collect()}
    assert got == {1: ("ab", "r", "stop", True), 2: ("only", "", "length", True), 3: ("open", "", None, False)}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"request_id": a, "seq": b, "line": c}) + "\n" for a, b, c in ROWS[k::2]))
    lines = events.files(spark, str(tmp_path / "in"), "request_id long, seq long, line string", at_once=1)
    query = events.assemble_stream(lines).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.request_id: (r.content, r.finish_reason) for r in spark.table("assembled").collect()}
    assert got == {1: ("ab", "stop"), 2: ("only", "length")}


def test_windows_and_first_occurrences(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value").write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    stream = events.files(spark, str(tmp_path / "in"), "event_type string, ts timestamp, value double", "parquet")
    query = events.windowed(stream, "ts", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r[0], r[1]): r[2] for r in source.groupBy(F.date_trunc("hour", "ts"), "event_type").count().collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("windows").collect()} == want
    query = events.first_seen(stream, "event_type", "ts", "10000 days").writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("firsts").count() == source.select("event_type").distinct().count()


@pytest.mark.parametrize("few", [200_000, 1])
def test_append_once(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(events, "FEW_KEYS", few)
    (tmp_path / "in").mkdir()
    schema = "job_id long, x string"
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"job_id": j, "x": "v"}) + "\n" for j in (1, 2, 2, 3 + k)))
        events.append_once(events.files(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), "job_id", str(tmp_path / f"ck{k}")).awaitTermination(120)
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]
