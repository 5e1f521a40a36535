import csv
import json

import pytest
from pyspark.sql import functions as F

from pairsmith.__main__ import main
from pairsmith.plans import reports
from pairsmith.plans.pipeline import Pipeline
from pairsmith.sources.providers import Deterministic
from pairsmith.sources.sessions import Session
from tests.test_switching import FILE, GOOD, config_at, server  # noqa: F401


def expression(cut):
    """Replies to the templates; with ``cut`` every chosen reply that has an even hash stops in the middle."""

    def reply(p, stage):
        if stage == "subtopics":
            return F.lit('["Sea", "Sky", "Sun"]')
        if stage == "prompts":
            return F.concat(F.lit('["'), F.md5(p), F.lit(' a", "'), F.md5(p), F.lit(' b"]'))
        ends = F.when(F.lit(cut) & p.endswith("b"), F.lit(GOOD + " And then")).otherwise(F.lit(GOOD))
        return F.concat(p, ends)

    return reply


@pytest.fixture
def output(spark, tmp_path):
    """Three sessions: two of one provider, in the later of which half of the replies are cut off, and one without a known provider."""
    for day, url, cut, mode in ((1, "https://api.openai.com/v1", False, "dpo"), (2, "https://api.openai.com/v1", True, "kto"), (3, "https://models.example.org/v1", False, "sft")):
        text = FILE.replace('dataset_mode = "dpo"', f'dataset_mode = "{mode}"').replace("concurrency = 2000", f"concurrency = {day * 8}")
        config = config_at(tmp_path, url, text)
        name = f"session_2025-11-0{day}T10-00-00"
        (tmp_path / "out" / name).mkdir(parents=True)
        session = Session(tmp_path / "out", name)
        session.keep_config(tmp_path / "config.toml")
        Pipeline(spark, config, session, {k: Deterministic(expression(cut)) for k in ("main", "rejected")}).run()
    return str(tmp_path / "out")


def test_reports_of_sessions_and_providers(spark, output, tmp_path):
    rows = {r.session[-11:-9]: r for r in reports.report(spark, "reliability", output).collect()}
    assert {d: (r.provider, r.total, r.complete, r.caught_incomplete, r.success) for d, r in rows.items()} == {
        "01": ("openai", 6, 6, 0, 100.0),
        "02": ("openai", 3, 3, 3, 50.0),
        "03": ("https://models.example.org/v1", 6, 6, 0, 100.0),
    }
    by = {r.provider: r for r in reports.report(spark, "providers", output).collect()}
    openai = by["openai"]
    assert (openai.sessions, openai.total, openai.caught_incomplete, openai.success, openai.latest[-11:-9], openai.latest_success) == (2, 9, 3, 75.0, "02", 50.0)
    assert [r.workers for r in reports.report(spark, "benchmark", output).collect()] == [8, 16, 24]
    assert reports.report(spark, "sessions", output, 1, 2).count() == 2 and reports.report(spark, "samples", output).count() == 0
    main(["report", "providers", "--output", output, "--json", f"{tmp_path}/r.json", "--markdown", f"{tmp_path}/r.md", "--csv", f"{tmp_path}/r.csv"])
    kept = json.loads((tmp_path / "r.json").read_text())
    assert [k["provider"] for k in kept] == ["https://models.example.org/v1", "openai"] and kept[1]["success"] == 75.0
    assert (tmp_path / "r.md").read_text().splitlines()[0].startswith("| provider | sessions |")
    assert len(list(csv.DictReader(next((tmp_path / "r.csv").glob("part-*")).open()))) == 2


def test_runs_with_several_numbers_of_workers(spark, tmp_path, server, capsys):  # noqa: F811
    """From the command line: replies that are no lists make the runs fail; both are told, and neither is the best."""
    config_at(tmp_path, server)
    main(["benchmark", "--workers", "2,4", "--config", f"{tmp_path}/config.toml", "--output", f"{tmp_path}/out", "--json", f"{tmp_path}/b.json"])
    kept = json.loads((tmp_path / "b.json").read_text())
    assert [k["workers"] for k in kept] == [2, 4] and all("no subtopics" in k["error"] for k in kept)
    assert "best" not in capsys.readouterr().out


def test_the_best_is_the_first_of_equals(tmp_path):
    config = config_at(tmp_path)
    seen = []

    def run(one):
        seen.append(one.generation.concurrency)
        if one.generation.concurrency == 3:
            raise RuntimeError("gone")
        return {"throughput": 2.0 if one.generation.concurrency > 1 else 1.0}

    results = reports.sweep(config, [1, 3, 4, 5], run)
    assert seen == [1, 3, 4, 5] and results[1] == {"workers": 3, "error": "RuntimeError: gone"}
    assert reports.best_of(results)["workers"] == 4 and reports.best_of(results[1:2]) is None
    assert config.generation.concurrency == 2000


def test_tables_of_any_text():
    assert reports.markdown(["a", "b"], [(None, 1.0), ("x|y\nz", 0.126)]) == "| a | b |\n| --- | --- |\n|  | 1 |\n| x\\|y z | 0.13 |\n"


@pytest.mark.parametrize(("waits", "blocking"), [(True, 50.0), (False, 0.0)])
def test_what_was_waited_for_the_rate_is_reported(spark, tmp_path, waits, blocking):
    """Half of the rejected replies waited; a provider that does not tell has waited for nothing."""

    class Waiting:
        def complete(self, requests, stage):
            out = Deterministic(expression(False)).complete(requests, stage)
            return out.withColumn("wait_ns", F.when((F.lit(stage) == "rejected") & (F.col("job_id") % 2 == 0), 5_000_000).otherwise(0).cast("long")) if waits else out.drop("wait_ns")

    session = Session(tmp_path / "out")
    Pipeline(spark, config_at(tmp_path), session, {k: Waiting() for k in ("main", "rejected")}).run()
    row = reports.report(spark, "benchmark", str(tmp_path / "out")).first()
    assert (row.jobs, row.blocking, row.wait_ms) == (6, blocking, blocking / 20)
