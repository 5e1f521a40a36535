"""What a user of another tool of this kind brings along: configurations with their templates, datasets with reasoning, sessions that are half done."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pairsmith.__main__ import all_sessions, check_resumable, http, inspected, main, parser, repository_of
from pairsmith.plans import transforms
from pairsmith.plans.pipeline import Pipeline
from pairsmith.sources import checkpoints
from pairsmith.sources import config as cfg
from pairsmith.sources import jsonl
from pairsmith.sources.providers import Deterministic, Http
from pairsmith.sources.sessions import Manifest, Session, SessionError, config_hash

FILE = """
provider_burst_percent = 20
[generation]
main_topic = "Nature"
num_subtopics = 3
num_prompts_per_subtopic = 2
dataset_mode = "dpo"
min_success_rate = 0.5
disable_validation_limits = true
concurrency = 2000
over_generation_buffer = 0.0
max_exclusion_list_size = 2
checkpoint_interval = 7
resume_from_session = ""
wrong_key = 1
[models.main]
base_url = "{url}"
model_name = "m"
top_p = 0.5
http_timeout_seconds = 7
use_json_mode = true
max_retries = -1
[models.rejected]
base_url = "{url}"
model_name = "r"
temperature = 0.0
max_retries = 0
rate_limit_per_minute = 60000
[models.judge]
enabled = false
[prompt_templates]
subtopic_generation = "subtopics of {{{{.MainTopic}}}}: {{{{.NumSubtopics}}}}{{{{if .IsRetry}}}} not {{{{.ExcludeSubtopics}}}}{{{{end}}}}"
prompt_generation = "{{{{.NumPrompts}}}} tasks on {{{{.SubTopic}}}} of {{{{.MainTopic}}}}"
chosen_generation = "Write: {{{{.Prompt}}}}"
rejected_generation = "Badly, on {{{{.SubTopic}}}}: {{{{.Prompt}}}}"
judge_rubric = "Rate {{{{.StoryText}}}} for {{{{.Prompt}}}}"
chosen_system_prompt = "You write."
judge_system_prompt = "You judge."
subtopic_system_prompt = ""
[huggingface]
repo_id = "me/data"
"""
GOOD = " is a reply that goes on long enough to pass every gate there is, with more words than it needs, and it ends well."


def config_at(tmp_path, url="http://localhost:1/v1", text=FILE, **options):
    (tmp_path / "config.toml").write_text(text.format(url=url))
    return cfg.load(tmp_path / "config.toml", **options)


def test_every_key_has_its_effect_or_is_told(tmp_path):
    c = config_at(tmp_path)
    g, main_model = c.generation, c.models["main"]
    assert (g.min_success_rate, g.concurrency, g.checkpoint_interval, c.repository, c.provider_burst_percent) == (0.5, 2000, 7, "me/data", 20)
    assert c.prompt_templates["chosen"] == "Write: {{.Prompt}}" and set(c.prompt_templates) == {"subtopics", "prompts", "chosen", "rejected", "judge"}
    assert c.system_prompts == {"chosen": "You write.", "judge": "You judge.", "judge_filter": "You judge."}
    assert c.notes == ["generation.wrong_key is unknown"]
    provider = http(main_model, cfg.Secrets({}), c)
    assert provider.attempts is None and provider.timeout == 7.0 and provider.deadlines["judge"] == 100.0
    body = provider.body("p", "chosen")
    assert body["messages"] == [{"role": "system", "content": "You write."}, {"role": "user", "content": "p"}]
    assert body["top_p"] == 0.5 and body["response_format"] == {"type": "json_object"}
    assert "response_format" not in http(c.models["rejected"], cfg.Secrets({}), c).body("p", "rejected")
    assert (c.models["rejected"].temperature, http(c.models["rejected"], cfg.Secrets({}), c).attempts) == (0.0, 1)


def test_a_zero_may_stand_for_the_default(tmp_path):
    c = config_at(tmp_path, zero_is_unset=True)
    assert (c.models["rejected"].temperature, c.models["rejected"].max_retries, c.generation.over_generation_buffer) == (0.7, 3, 0.15)
    assert c.models["judge"].enabled is False


@pytest.mark.parametrize(
    ("old", "new", "what"),
    [
        ("{{{{.NumPrompts}}}} tasks", "{{{{.Topic}}}} tasks", "no field Topic"),
        ("{{{{.NumPrompts}}}} tasks", "{{{{if .NumPrompts}}}} tasks", "if without end"),
        ("top_p = 0.5", "top_p = 1.5", "top_p"),
        ('model_name = "m"', "model_name = 7", "must be str"),
        ("concurrency = 2000", "concurrency = true", "must be int"),
        ('dataset_mode = "dpo"', 'dataset_mode = "mo-dpo"', "judge is missing or not enabled"),
        ("disable_validation_limits = true", "prompt_retry_attempts = 6\nconcurrency = 8", "prompt_retry_attempts|TOML|overwrite"),
        ("http_timeout_seconds = 7", "http_timeout_seconds = 0", "timeouts"),
    ],
)
def test_what_cannot_be_used_is_an_error_before_any_call(tmp_path, old, new, what):
    assert old in FILE
    with pytest.raises(cfg.ConfigError, match=what):
        config_at(tmp_path, text=FILE.replace(old, new).replace("concurrency = 2000\n", "" if "prompt_retry" in new else "concurrency = 2000\n"))


def test_templates_reach_the_models(spark, tmp_path):
    """Every stage asks by its own template; the second request for subtopics names what there is, the last two of it."""
    asked = []

    class Noting:
        def complete(self, requests, stage):
            asked.extend((stage, r.prompt) for r in requests.collect())
            p = F.col("prompt")
            content = {
                "subtopics": F.when(p.contains(" not "), F.lit('["Sun"]')).otherwise(F.lit('["Sea", "Sky", "sea"]')),
                "prompts": F.concat(F.lit('["'), F.md5(p), F.lit('", "b"]')),
                "chosen": F.concat(p, F.lit(GOOD)),
                "rejected": p,
            }[stage]
            return Deterministic(lambda _, s: content).complete(requests, stage)

    session = Session(tmp_path)
    Pipeline(spark, config_at(tmp_path), session, {k: Noting() for k in ("main", "rejected")}).run()
    by = {stage: sorted(p for s, p in asked if s == stage) for stage in ("subtopics", "prompts", "chosen", "rejected")}
    assert by["subtopics"] == ["subtopics of Nature: 1 not Sea, Sky", "subtopics of Nature: 3"]
    assert by["prompts"] == ["2 tasks on Sea of Nature", "2 tasks on Sky of Nature", "2 tasks on Sun of Nature"]
    assert len(by["chosen"]) == 6 and all(p.startswith("Write: ") for p in by["chosen"])
    assert sorted(p.split(": ")[0] for p in by["rejected"]) == [f"Badly, on {t}" for t in ("Sea", "Sea", "Sky", "Sky", "Sun", "Sun")]


class Echo(BaseHTTPRequestHandler):
    calls: list = []
    fail = 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Echo.calls.append(body["messages"][-1]["content"])
        code = 200
        if Echo.fail:
            Echo.fail, code = Echo.fail - 1, 503
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": f" new {len(body['messages'])} {body['messages'][-1]['content']} "}, "finish_reason": "stop"}]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Echo.calls, Echo.fail = [], 0
    here = ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    threading.Thread(target=here.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{here.server_port}"
    here.shutdown()


def test_a_call_is_repeated_without_end_until_its_time_is_over(server):
    Echo.fail = 9
    patient = Http(server, "m", rpm=100_000, attempts=None, base_delay=0.0)
    assert patient.call("p", "chosen", [], sleep=lambda _: None).content == " new 1 p " and len(Echo.calls) == 10
    Echo.fail = 10**9
    assert Http(server, "m", attempts=None, base_delay=0.0, deadlines={"judge": 0.3}).call("p", "judge", [], sleep=lambda _: None).error == "no time left"
    Echo.fail = 0


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_transforms_ask_by_the_template(spark, tmp_path, server):
    """From the command line, over HTTP: supervised records to pairs, and both kinds of regeneration."""
    config_at(tmp_path, server)
    say = lambda *a: main([*map(str, a), "--config", str(tmp_path / "config.toml")])
    (tmp_path / "sft.jsonl").write_text(json.dumps({"sub_topic": "Sea", "instruction": " q1", "input": "more", "output": "a1"}) + "\n\n" + json.dumps({"instruction": "q2", "output": "a2"}) + "\n")
    say("transform", "--mode", "sft-to-dpo", "--format", "alpaca", "--input", tmp_path / "sft.jsonl", "--output", tmp_path / "dpo")
    assert lines(tmp_path / "dpo") == [
        {"prompt": "q1\n\nmore", "chosen": "a1", "rejected": "new 1 Badly, on Sea: q1\n\nmore"},
        {"prompt": "q2", "chosen": "a2", "rejected": "new 1 Badly, on : q2"},
    ]
    (tmp_path / "plain.jsonl").write_text(json.dumps({"prompt": " p ", "chosen": "<think>r</think>c", "rejected": "old"}) + "\n")
    say("transform", "--mode", "regen", "--input", tmp_path / "plain.jsonl", "--output", tmp_path / "plain")
    assert lines(tmp_path / "plain") == [{"prompt": " p ", "chosen": "<think>r</think>c", "rejected": "new 1 Badly, on :  p"}]
    (tmp_path / "thought.jsonl").write_text(json.dumps({"prompt": " p ", "chosen": "<think>r</think>c", "rejected": "<think>t</think>old"}) + "\n")
    say("transform", "--mode", "regen-rejected", "--input-reasoning", tmp_path / "thought.jsonl", "--output", tmp_path / "bare", "--output-reasoning", tmp_path / "thought")
    assert lines(tmp_path / "bare") == [{"prompt": "p", "chosen": "c", "rejected": "new 1 Badly, on : p"}]
    assert lines(tmp_path / "thought") == [{"prompt": " p ", "chosen": "<think>r</think>c", "rejected": "<think>\nt\n</think>\n\nnew 1 Badly, on : p"}]
    assert len(Echo.calls) == 4
    for wrong in (["--input", "x"], ["--output", "y"], ["--input", "x", "--output", "y", "--output-reasoning", "z"], ["--input", "x", "--output", "x"], ["--input", "x", "--output", "y", "--resume"]):
        with pytest.raises(SystemExit):
            say("transform", "--mode", "regen", *wrong)
    with pytest.raises(SystemExit):
        say("transform", "--mode", "sft-to-dpo", "--input-reasoning", "x", "--output", "y")
    assert transforms.has_replies(spark, str(tmp_path / "bare.replies")) and not transforms.has_replies(spark, str(tmp_path / "none"))


def test_where_to_publish(tmp_path):
    c = config_at(tmp_path)
    ask = lambda *a: repository_of(parser().parse_args(["run", *a]), c)
    assert (ask(), ask("--upload-to-hf"), ask("--hf-repo-id", "a/b"), ask("--upload-to-hf", "--hf-repo-id", "a/b")) == (None, "me/data", "a/b", "a/b")
    c.repository = ""
    with pytest.raises(SystemExit):
        ask("--upload-to-hf")


def half_done(folder, done, records, phase="pairs", jobs=6):
    folder.mkdir()
    prompts = [{"ID": k, "MainTopic": "Nature", "SubTopic": "Sea" if k < 3 else "Sky", "Prompt": f"prompt {k // 2 if k > 3 else k}"} for k in range(jobs)]
    (folder / "checkpoint.json").write_text(json.dumps({
        "session_id": "u", "created_at": "2025-10-30T14:30:00Z", "last_saved_at": "2025-10-30T15:00:00Z", "current_phase": phase, "subtopics_complete": True, "subtopics": ["Sea", "Sky"],
        "prompts_complete": jobs > 0, "prompts": prompts or None, "failed_subtopics": None, "prompt_success_rate": 1, "completed_job_ids": {str(k): True for k in done},
        "stats": {"StartTime": "2025-10-30T14:30:00Z", "TotalPrompts": 6, "SuccessCount": 2, "FailureCount": 0, "FilteredCount": 0, "TotalDuration": 5, "AverageDuration": 2},
        "config_hash": config_hash("Nature", 3, 2), "more": 1,
    }))
    if records is not None:
        (folder / "dataset.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))


def test_checkpoints_as_tables(spark, tmp_path):
    half_done(tmp_path / "session_2025-10-30T14-30-00", [0, 2], None)
    half_done(tmp_path / "session_2025-10-31T14-30-00", [], None, "prompts", 0)
    (tmp_path / "session_2025-11-01T14-30-00").mkdir()
    (tmp_path / "session_2025-11-01T14-30-00/checkpoint.json").write_text("{cut off")
    found = checkpoints.scan_checkpoints(spark, f"{tmp_path}/*/checkpoint.json")
    assert sorted(tuple(r)[1:] for r in checkpoints.progress_of(found).collect()) == [("pairs", 2, 2, 6, 200 / 6), ("prompts", 2, 0, 0, 0.0)]
    assert sorted(r.job_id for r in checkpoints.pending_of(found).collect()) == [1, 3, 4, 5]
    assert {r.session for r in checkpoints.jobs_of(found).collect()} == {"session_2025-10-30T14-30-00"} and checkpoints.subtopics_of(found).count() == 4
    with pytest.raises(Exception, match="no readable checkpoint"):
        checkpoints.scan_checkpoints(spark, f"{tmp_path}/*/checkpoint.json", strict=True).collect()
    assert [s["session"] for s in all_sessions(str(tmp_path))] == ["session_2025-10-31T14-30-00", "session_2025-10-30T14-30-00"]
    assert inspected(tmp_path / "session_2025-10-30T14-30-00")["percent"] == 200 / 6


def test_a_session_of_another_tool_is_finished(spark, tmp_path):
    """Records decide what is done: job 1 was written after the last checkpoint, job 5 is counted there but was never written; of jobs 2, 4 and 5 with one prompt one is there."""
    name = "session_2025-10-30T14-30-00"
    half_done(tmp_path / name, [0, 5], [{"prompt": f"prompt {k}", "chosen": f"old {k}", "rejected": "r"} for k in range(3)])
    asked = []

    class Noting:
        def complete(self, requests, stage):
            asked.extend((stage, r.job_id) for r in requests.collect())
            return Deterministic(lambda p, s: F.concat(p, F.lit(GOOD))).complete(requests, stage)

    config, session = config_at(tmp_path), Session(tmp_path, name)
    check_resumable(session, config)
    out = Pipeline(spark, config, session, {k: Noting() for k in ("main", "rejected")}).run()
    assert sorted(asked) == [("chosen", 3), ("chosen", 4), ("chosen", 5), ("rejected", 3), ("rejected", 4), ("rejected", 5)]
    data = lines(session.folder / "dataset.jsonl")
    assert len(data) == 6 and sum(d["chosen"].startswith("old") for d in data) == 3 and (out["total"], out["success"]) == (6, 6)
    with pytest.raises(SessionError):
        check_resumable(Session(tmp_path, name), config)
    assert Manifest.load(session.folder).phase == "complete"


@pytest.mark.parametrize(
    ("records", "want"),
    [
        ([{"prompt": " a ", "completion": "x", "label": True}, {"prompt": "a", "completion": "y", "label": False}, {"prompt": "b", "completion": "x", "label": True}], {"a": 1, "b": 0}),
        ([{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "x"}]}, {"instruction": "b", "output": "y"}, {"instruction": "", "output": "y"}], {"a": 1, "b": 1}),
        ([{"prompt": "a", "chosen": "x", "rejected": "y", "preference_margin": 1.0}] * 2, {"a": 2}),
    ],
)
def test_records_of_every_shape_tell_their_prompts(spark, tmp_path, records, want):
    (tmp_path / "d.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records) + "not json\n")
    assert {r.prompt: r.n for r in checkpoints.prompts_in(spark, str(tmp_path / "d.jsonl")).collect()} == want


def test_what_is_not_taken_over(spark, tmp_path):
    half_done(tmp_path / "session_2025-10-30T14-30-00", [], [], "complete")
    (tmp_path / "session_2025-10-31T14-30-00").mkdir()
    for name in ("session_2025-10-30T14-30-00", "session_2025-10-31T14-30-00"):
        with pytest.raises(SessionError):
            checkpoints.adopt(spark, Session(tmp_path, name))
    half_done(tmp_path / "session_2025-11-01T14-30-00", [], None, "prompts", 0)
    assert checkpoints.adopt(spark, Session(tmp_path, "session_2025-11-01T14-30-00")).phase == "prompts"


def test_pairs_without_reasoning_stay_as_they_are(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(json.dumps({"prompt": " p ", "chosen": "<think>r</think>c", "rejected": "old"}) + "\n" + json.dumps({"prompt": "q", "chosen": "d"}) + "\n")
    rows = transforms.regen_plain(jsonl.scan_dpo(spark, str(tmp_path / "in.jsonl")), Deterministic(lambda p, s: F.concat(F.lit("new "), p)), spark.createDataFrame([(2,)], "job_id long"))
    assert [tuple(r) for r in rows.collect()] == [(1, " p ", "<think>r</think>c", "new  p")]
