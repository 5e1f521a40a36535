import json

import pytest
from pyspark.sql import functions as F

from pairsmith.__main__ import main
from pairsmith.plans import transforms
from pairsmith.sources import jsonl
from pairsmith.sources.providers import Deterministic
from pairsmith.streaming.transforms import complete_replies, lines_of, transform_stream, usable
from tests.test_switching import config_at, server  # noqa: F401

LONG = "A reply of good length that goes on long enough to pass every gate there is, with some more words, and it ends well."


def talk(q, a):
    return json.dumps({"conversations": [{"from": "human", "value": q}, {"from": "gpt", "value": a}]})


class Asked:
    """Notes what it is asked; the prompt ``bad`` fails while ``failing``."""

    def __init__(self):
        self.prompts, self.failing = [], False

    def complete(self, requests, stage):
        self.prompts += [r.prompt for r in requests.collect()]
        out = Deterministic(lambda p, s: F.concat(F.lit("new "), p)).complete(requests, stage)
        bad = requests.where(F.col("prompt") == "bad").select("job_id").withColumn("_bad", F.lit(self.failing))
        out = out.join(bad, "job_id", "left").withColumn("error", F.when(F.col("_bad"), "status 400")).drop("_bad")
        return out.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def records(spark, path):
    return sorted(json.dumps(r.asDict(), sort_keys=True) for r in spark.read.json(path).drop("batch").collect())


def test_batches_make_what_one_scan_makes(spark, tmp_path):
    """Files that come later, equal lines, lines that cannot be used, and a call that fails first."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join([talk("q1", "a1"), talk("q1", "a1"), "", "{cut", talk(" ", "a"), talk("q2", " ")]) + "\n")
    provider, out = Asked(), str(tmp_path / "out")

    def run():
        query = transform_stream(lines_of(spark, str(tmp_path / "in"), 1), "sft-to-dpo", provider, out, str(tmp_path / "ck"), text="{{.Prompt}}")
        query.awaitTermination(240)
        return query

    run()
    assert provider.prompts == ["q1"]
    assert sorted((r.line, r.problem) for r in spark.read.parquet(f"{out}/rejects").collect()) == sorted([("{cut", "no JSON object"), (talk(" ", "a"), "no prompt"), (talk("q2", " "), "no reply")])
    (tmp_path / "in/b.jsonl").write_text("\n".join([talk("bad", "b"), talk("q3", "c"), talk("q1", "a1")]) + "\n")
    provider.failing = True
    with pytest.raises(Exception, match="1 calls failed"):
        run()
    assert sorted(provider.prompts) == ["bad", "q1", "q1", "q3"] and len(records(spark, f"{out}/dataset")) == 2
    provider.failing = False
    run()
    assert sorted(provider.prompts) == ["bad", "bad", "q1", "q1", "q3"]
    run()
    (tmp_path / "all.jsonl").write_text("\n".join([talk("q1", "a1")] * 3 + [talk("bad", "b"), talk("q3", "c")]))
    whole = transforms.sft_to_dpo(jsonl.scan_sft(spark, str(tmp_path / "all.jsonl")), "sharegpt", Deterministic(lambda p, s: F.concat(F.lit("new "), p))).drop("line_no")
    assert records(spark, f"{out}/dataset") == sorted(json.dumps(r.asDict(), sort_keys=True) for r in whole.collect())


@pytest.mark.parametrize("mode", ["regen-rejected", "regen-plain"])
def test_regeneration(spark, tmp_path, mode):
    (tmp_path / "in").mkdir()
    rows = [{"prompt": " p ", "chosen": f"<think>r</think>{LONG}", "rejected": "<think>t</think>old"}, {"prompt": "q", "chosen": "short", "rejected": "old"}, {"prompt": " ", "chosen": "c"}, {"prompt": "r"}]
    (tmp_path / "in/a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = str(tmp_path / "out")
    transform_stream(lines_of(spark, str(tmp_path / "in")), mode, Asked(), out, str(tmp_path / "ck"), keep=complete_replies).awaitTermination(240)
    told = sorted(r.problem for r in spark.read.parquet(f"{out}/rejects").collect())
    if mode == "regen-plain":
        assert [tuple(r) for r in spark.read.json(f"{out}/dataset").select("prompt", "chosen", "rejected").collect()] == [(" p ", f"<think>r</think>{LONG}", "new  p")]
        assert told == ["no prompt", "no reply"]
    else:
        assert [tuple(r) for r in spark.read.json(f"{out}/dataset").select("prompt", "chosen", "rejected").collect()] == [("p", LONG, "new p")]
        assert [r.rejected for r in spark.read.json(f"{out}/dataset_reasoning").collect()] == ["<think>\nt\n</think>\n\nnew p"]
        assert told == ["no prompt"]


def test_usable_lines_of_a_table(spark):
    lines = spark.createDataFrame([("f", '{"prompt": "p", "chosen": "c", "x": 1}'), ("f", "[1]"), ("f", '{"prompt": 1}'), ("f", "{}")], "file string, line string")
    got = sorted((r.line, r.problem) for r in usable(lines, "regen-plain").collect())
    assert got == sorted([('{"prompt": "p", "chosen": "c", "x": 1}', None), ("[1]", "no JSON object"), ('{"prompt": 1}', "no reply"), ("{}", "no prompt")], key=lambda x: x[0])


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        transform_stream(None, "x", None, "o", "c")


def test_from_the_command_line(spark, tmp_path, server):  # noqa: F811
    """Files of a folder, over HTTP, by the configuration's template."""
    config_at(tmp_path, server)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps({"prompt": "p", "chosen": LONG}) + "\n" + json.dumps({"prompt": "q", "chosen": "no"}) + "\n")
    main(["stream", "--mode", "regen-plain", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--gated", "--config", f"{tmp_path}/config.toml"])
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/out/dataset").select("prompt", "chosen", "rejected").collect()] == [("p", LONG, "new 1 Badly, on : p")]
