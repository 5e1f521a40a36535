import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pairsmith.plans import transforms
from pairsmith.plans.pipeline import Pipeline, PipelineError
from pairsmith.sources import config as cfg
from pairsmith.sources import hub, jsonl
from pairsmith.sources.providers import Bucket, Deterministic, Http, Replay, effective_rate, model_bucket, prompt_key, provider_bucket, wait_before
from pairsmith.sources.sessions import Manifest, Session, SessionError, check_name, sessions

LONG = "A reply of good length about %s that goes on long enough to pass every gate there is, and it ends well."


def expression(prompt, stage):
    if stage in ("subtopics", "prompts"):
        words = F.when(prompt.contains("subtopics"), F.lit('["Sea", "sea ", "Sky", "Sun"]')).otherwise(F.concat(F.lit('["one '), F.substring(F.md5(prompt), 1, 6), F.lit('", "two",]')))
        return words
    if stage in ("judge", "judge_filter"):
        return F.when(prompt.contains("worse"), F.lit('{"a": {"score": 1}}')).when(prompt.contains("two"), F.lit('{"a": {"score": 2}}')).otherwise(F.lit('{"a": {"score": 5}}'))
    if stage == "rejected":
        return F.concat(F.lit("worse "), prompt)
    return F.concat(F.lit("A reply of good length about "), prompt, F.lit(" that goes on long enough to pass every gate there is, and it ends well."))


def settings(mode="dpo", **more):
    model = cfg.Model("http://localhost:1/v1", "m")
    g = cfg.Generation("Nature", 3, 2, dataset_mode=mode, over_generation_buffer=0.0, **more)
    return cfg.Config(g, {k: model for k in ("main", "rejected", "judge")})


def lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


@pytest.mark.parametrize(("mode", "rows"), [("dpo", 6), ("kto", 12), ("sft", 6), ("mo-dpo", 6)])
def test_modes(spark, tmp_path, mode, rows):
    provider = Deterministic(expression, lambda p, s: F.lit("because"))
    session = Session(tmp_path)
    out = Pipeline(spark, settings(mode, enable_reasoning_capture=True), session, {k: provider for k in ("main", "rejected", "judge")}).run()
    assert (out["total"], out["success"], out["failure"]) == (6, 6, 0)
    data = lines(session.folder / "dataset.jsonl")
    assert len(data) == rows
    if mode == "mo-dpo":
        assert {d["rejected_score_total"] for d in data} == {1.0} and {d["chosen_score_total"] for d in data} == {5.0, 2.0}
    else:
        reasoned = lines(session.folder / "dataset_reasoning.jsonl")
        assert len(reasoned) == rows and "<think>" in json.dumps(reasoned[0])
    if mode == "sft":
        assert set(data[0]) == {"conversations"}
    assert sessions(tmp_path)[0]["phase"] == "complete"


def test_filter(spark, tmp_path):
    config = settings("dpo")
    config.judge_filtering = cfg.JudgeFiltering(True)
    out = Pipeline(spark, config, session := Session(tmp_path), {k: Deterministic(expression) for k in ("main", "rejected", "judge")}).run()
    assert (out["success"], out["filtered"]) == (3, 3) and len(lines(session.folder / "dataset.jsonl")) == 3


def test_resume_loses_and_repeats_nothing(spark, tmp_path):
    session, asked = Session(tmp_path), []

    class Flaky:
        def __init__(self, fail):
            self.fail = fail

        def complete(self, requests, stage):
            asked.append((stage, sorted(r.job_id for r in requests.collect())))
            out = Deterministic(expression).complete(requests, stage)
            return out.withColumn("content", F.when((F.lit(stage) == "chosen") & (F.col("job_id") % 2 == 0), F.lit("no")).otherwise(F.col("content"))) if self.fail else out

    first = Pipeline(spark, settings(), session, {k: Flaky(True) for k in ("main", "rejected")})
    assert first.pairs(first.jobs(first.subtopics())).count() == 3
    asked.clear()
    again = Pipeline(spark, settings(), Session(tmp_path, session.name), {k: Flaky(False) for k in ("main", "rejected")})
    out = again.run()
    assert asked == [("chosen", [0, 2, 4]), ("rejected", [0, 2, 4])]
    assert (out["total"], out["success"]) == (6, 6) and len(lines(session.folder / "dataset.jsonl")) == 6


def test_too_few_prompts(spark, tmp_path):
    bad = Deterministic(lambda p, s: F.when(p.contains("subtopics"), F.lit('["a", "b", "c"]')).otherwise(F.lit("sorry")))
    with pytest.raises(PipelineError):
        Pipeline(spark, settings(), Session(tmp_path), {"main": bad}).run()


def test_scans_and_transforms(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('\n{"conversations": [{"from": "human", "value": "q1"}, {"from": "gpt", "value": "a1"}]}\n  \n{"conversations": [{"from": "user", "value": "q2"}, {"from": "assistant", "value": "<think>t</think>a2"}], "x": 1}\n')
    rows = jsonl.scan_sft(spark, str(tmp_path / "in.jsonl"))
    assert sorted(r.line_no for r in rows.collect()) == [2, 4]
    got = sorted(tuple(r) for r in transforms.sft_to_dpo(rows, "sharegpt", Deterministic(expression)).collect())
    assert got == [(2, "q1", "a1", "worse q1"), (4, "q2", "<think>t</think>a2", "worse q2")]
    done = spark.createDataFrame([(2,)], "job_id long")
    assert [r.line_no for r in transforms.sft_to_dpo(rows, "sharegpt", Deterministic(expression), done).collect()] == [4]
    (tmp_path / "bad.jsonl").write_text('{"prompt": "p", "chosen": "c"}\nnot json\n')
    with pytest.raises(Exception, match="line 2"):
        jsonl.scan_dpo(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "blank.jsonl").write_text('{"prompt": " ", "chosen": "c"}\n')
    with pytest.raises(Exception, match="line 1"):
        jsonl.scan_dpo(spark, str(tmp_path / "blank.jsonl")).collect()


def test_regeneration(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(json.dumps({"prompt": " p ", "chosen": "<think>r</think>", "rejected": "<think>t</think>old"}) + "\n" + json.dumps({"prompt": "p2", "chosen": "<think>r</think>c", "rejected": "old"}) + "\n")
    plain, reasoned = transforms.regen_rejected(jsonl.scan_dpo(spark, str(tmp_path / "in.jsonl")), Deterministic(lambda p, s: F.lit(" n Let's start over")))
    assert sorted(tuple(r)[1:] for r in plain.collect()) == [("p", "<think>r</think>", "n"), ("p2", "c", "n")]
    assert sorted(tuple(r)[1:] for r in reasoned.collect()) == [(" p ", "<think>r</think>", "<think>\nt\n</think>\n\nn"), ("p2", "<think>r</think>c", "n")]
    with pytest.raises(Exception, match="empty reply"):
        transforms.regen_rejected(jsonl.scan_dpo(spark, str(tmp_path / "in.jsonl")), Deterministic(lambda p, s: F.lit(" ")))[0].collect()


def test_line_numbers_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (tmp_path / "big.txt").write_text("".join(f"row {k}\n" for k in range(1, 3001)))
        got = jsonl.numbered_lines(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000 and all(r.line == f"row {r.line_no}" for r in got)


def test_replay(spark):
    asks = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, prompt string")
    recorded = asks.where("job_id = 1").select(prompt_key(F.lit("s"), F.col("prompt")).alias("key"), F.lit("A").alias("content"), F.lit("").alias("reasoning_content"), F.lit("stop").alias("finish_reason"))
    assert [tuple(r)[:2] for r in Replay(recorded, lenient=True).complete(asks, "s").collect()] == [(1, "A")]
    with pytest.raises(Exception, match="job 2"):
        Replay(recorded).complete(asks, "s").collect()


class Stub(BaseHTTPRequestHandler):
    calls: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        Stub.calls.append(prompt)
        code = 500 if prompt == "flaky" and Stub.calls.count(prompt) < 3 else 429 if prompt == "limit" and Stub.calls.count(prompt) < 2 else 400 if prompt == "bad" else 200
        self.send_response(code)
        self.end_headers()
        if body["stream"]:
            for x in ("", "data: {bad", 'data: {"choices": [{"delta": {"content": "a", "reasoning_content": "r"}}]}', 'data: {"choices": [{"delta": {"content": "b"}, "finish_reason": "stop"}]}', "data: [DONE]", 'data: {"choices": [{"delta": {"content": "late"}}]}'):
                self.wfile.write(x.encode() + b"\n")
        else:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": prompt.upper()}, "finish_reason": "stop"}]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    Stub.calls = []
    s = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1"
    s.shutdown()


def test_http(spark, server):
    provider = Http(server, "m", rpm=60_000, tasks=2, base_delay=0.01, max_delay=0.05)
    asks = spark.createDataFrame([(1, "hi"), (2, "flaky"), (3, "bad"), (4, "limit")], "job_id long, prompt string")
    got = {r.job_id: (r.content, r.finish_reason) for r in provider.complete(asks, "chosen").collect()}
    assert got == {1: ("HI", "stop"), 2: ("FLAKY", "stop"), 3: (None, None), 4: ("LIMIT", "stop")}
    assert Stub.calls.count("flaky") == 3 and Stub.calls.count("bad") == 1
    errors = {r.job_id: (r.error, r.duration_ns > 0) for r in provider.complete(asks.where("job_id in (1, 3)"), "chosen").collect()}
    assert errors == {1: (None, True), 3: ("status 400", True)}
    streaming = Http(server, "m", rpm=60_000, tasks=1, stream=True)
    assert streaming.complete(asks.where("job_id = 1"), "chosen").first()[:5] == (1, "ab", "r", "stop", None)


def failing(mode, bad_stage, server):
    """Main replies by expression, the others over HTTP to a server that refuses every prompt."""

    class Refused(Http):
        def body(self, prompt, stage):
            return {**super().body(prompt, stage), "messages": [{"role": "user", "content": "bad"}]}

    main, refused = Deterministic(expression), Refused(server, "m", rpm=60_000, tasks=2, base_delay=0.01)
    return {k: refused if k == bad_stage else main for k in ("main", "rejected", "judge")}


def test_errors_are_no_replies(spark, tmp_path, server):
    session = Session(tmp_path)
    out = Pipeline(spark, settings("dpo"), session, failing("dpo", "rejected", server)).run()
    assert (out["total"], out["success"], out["failure"]) == (6, 0, 6) and Stub.calls.count("bad") == 6
    assert lines(session.folder / "dataset.jsonl") == []
    for file in session.folder.glob("dataset*/part-*"):
        assert "status 400" not in file.read_text()
    reasons = {r.failure_reason for r in spark.read.parquet(session.path("pairs")).collect()}
    assert reasons == {"call failed: status 400"}


def test_a_run_goes_on_in_the_middle_of_a_phase(spark, tmp_path):
    session, asked = Session(tmp_path), []

    class Dying:
        """Fails as a whole once the first slice of replies is written."""

        def __init__(self, slices):
            self.slices = slices

        def complete(self, requests, stage):
            if stage == "chosen":
                if self.slices == 0:
                    raise RuntimeError("the machine is gone")
                self.slices -= 1
                asked.extend(r.job_id for r in requests.collect())
            return Deterministic(expression).complete(requests, stage)

    import pairsmith.plans.pipeline as module

    whole, module.SLICE = module.SLICE, 2
    try:
        with pytest.raises(RuntimeError, match="gone"):
            Pipeline(spark, settings(), session, {k: Dying(1) for k in ("main", "rejected")}).run()
        before = list(asked)
        out = Pipeline(spark, settings(), Session(tmp_path, session.name), {k: Dying(9) for k in ("main", "rejected")}).run()
    finally:
        module.SLICE = whole
    assert 0 < len(before) < 6 and sorted(asked) == list(range(6)) and out["success"] == 6
    manifest = Manifest.load(session.folder)
    assert manifest.failed_subtopics == [] and manifest.prompt_success_rate == 1.0
    log = [json.loads(x) for x in (session.folder / "session.log").read_text().splitlines()]
    assert log[-1]["msg"] == "session complete" and log[-1]["successful"] == 6 and log[-1]["duration"] > 0


def test_a_run_that_ended_after_its_dataset_can_be_resumed(spark, tmp_path):
    provider = {k: Deterministic(expression) for k in ("main", "rejected")}
    session = Session(tmp_path)
    Pipeline(spark, settings(), session, provider).run()
    Manifest(session.name, Manifest.load(session.folder).config_hash, "pairs").save(session.folder)
    out = Pipeline(spark, settings(), Session(tmp_path, session.name), provider).run()
    assert out["success"] == 6 and len(lines(session.folder / "dataset.jsonl")) == 6


def test_each_line_is_asked_about_once(spark, tmp_path, server):
    """Ten pairs, ten calls, both outputs from the same replies; what failed is asked again, and nothing else."""
    rows = [{"prompt": f"p{k}" if k != 7 else "bad", "chosen": f"c{k}", "rejected": "old"} for k in range(10)]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    provider, ledger = Http(server, "m", rpm=60_000, tasks=3, attempts=1), str(tmp_path / "replies")
    pairs = jsonl.scan_dpo(spark, str(tmp_path / "in.jsonl"))
    with pytest.raises(transforms.TransformError, match="line 8: status 400"):
        transforms.regen_rejected(pairs, provider, ledger=ledger)
    assert len(Stub.calls) == 10
    mended = pairs.withColumn("prompt", F.when(F.col("prompt") == "bad", "good").otherwise(F.col("prompt")))
    plain, reasoned = transforms.regen_rejected(mended, provider, ledger=ledger)
    a, b = ({r.job_id: r.rejected for r in f.orderBy("job_id").collect()} for f in (plain, reasoned))
    assert a == b == {k + 1: f"P{k}" if k != 7 else "GOOD" for k in range(10)} and len(Stub.calls) == 11
    Stub.calls.clear()
    done = spark.range(1, 10).toDF("job_id")
    left, _ = transforms.regen_rejected(pairs, provider, done)
    assert [r.job_id for r in left.collect()] == [10] and Stub.calls == ["p9"]


def test_threads_share_a_bucket():
    from concurrent.futures import ThreadPoolExecutor

    waits = []
    bucket = Bucket(1.0, 1, lambda: 0.0, waits.append)
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda _: bucket.take(), range(200)))
    assert sorted(waits) == [float(k) for k in range(1, 200)]


class Hub(BaseHTTPRequestHandler):
    seen: list = []
    busy = 1

    def _answer(self, method):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        Hub.seen.append((method, self.path, self.headers.get("Authorization"), body))
        reply, code = {}, 200
        if self.path.endswith("/repos/create"):
            code = 409
        elif self.path.endswith("/objects/batch"):
            here = f"http://127.0.0.1:{self.server.server_port}"
            reply = {"objects": [{"oid": o["oid"], "size": o["size"], "actions": {"upload": {"href": f"{here}/done", "header": {"chunk_size": "5000000", "1": f"{here}/part/1", "2": f"{here}/part/2", "3": f"{here}/part/3"}}}} for o in json.loads(body)["objects"]]}
        elif "/commit/" in self.path and Hub.busy:
            Hub.busy, code = 0, 503
        self.send_response(code)
        if self.path.startswith("/part/"):
            self.send_header("ETag", f"tag{self.path[-1]}")
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def do_POST(self):
        self._answer("POST")

    def do_PUT(self):
        self._answer("PUT")

    def log_message(self, *args):
        pass


def test_a_session_is_published(spark, tmp_path):
    """After a real run: the parts of its dataset go inline, a large one in parts, and the commit is sent again when the hub is busy."""
    session = Session(tmp_path)
    Pipeline(spark, settings(), session, {k: Deterministic(expression) for k in ("main", "rejected")}).run()
    (session.folder / "dataset_reasoning.jsonl").write_bytes(b"x" * 12_000_000)
    hub_server = ThreadingHTTPServer(("127.0.0.1", 0), Hub)
    threading.Thread(target=hub_server.serve_forever, daemon=True).start()
    try:
        send = hub.http_transport("secret", f"http://127.0.0.1:{hub_server.server_port}")
        done = hub.upload(session.folder, "me/data", send, sleep=lambda _: None)
    finally:
        hub_server.shutdown()
    names = [f[0] for f in done["files"]]
    assert any(n.startswith("dataset") and n.endswith(".jsonl") and n != "dataset_reasoning.jsonl" for n in names) and "dataset_reasoning.jsonl" in names
    parts = [b for m, p, _, b in Hub.seen if p.startswith("/part/")]
    assert [len(b) for b in parts] == [5_000_000, 5_000_000, 2_000_000] and all(a is None for _, p, a, _ in Hub.seen if p.startswith("/part/"))
    finished = json.loads(next(b for _, p, _, b in Hub.seen if p == "/done"))
    assert [x["etag"] for x in finished["parts"]] == ["tag1", "tag2", "tag3"]
    commits = [b for _, p, a, b in Hub.seen if p == "/api/datasets/me/data/commit/main" and a == "Bearer secret"]
    assert len(commits) == 2 and len(commits[-1].splitlines()) == len(names) + 1
    with pytest.raises(hub.HubError):
        hub.upload(tmp_path, "me/data")


def test_reports(spark, tmp_path):
    from pairsmith.plans.reports import report as report_of

    session = Session(tmp_path)
    Pipeline(spark, settings(), session, {k: Deterministic(expression) for k in ("main", "rejected")}).run()
    assert report_of(spark, "sessions", str(tmp_path), 1, 5).first().jobs == 6
    kinds = report_of(spark, "reliability", str(tmp_path), 1, 5).first()
    assert (kinds.session, kinds.total, kinds.complete, kinds.caught_incomplete, kinds.success) == (session.name, 6, 6, 0, 100.0)
    times = report_of(spark, "benchmark", str(tmp_path), 1, 5).first()
    assert times.jobs == 6 and times.duration_s > 0 and times.throughput > 0


def test_limits():
    now, slept = [0.0], []
    bucket = Bucket(2.0, 3, lambda: now[0], lambda s: slept.append(s))
    assert [bucket.take() for _ in range(5)] == [0, 0, 0, 0.5, 1.0] and slept == [0.5, 1.0]
    assert model_bucket(60) == (1.0, 12) and model_bucket(10)[1] == 5 and provider_bucket(10, 15)[1] == 3 and provider_bucket(100, 15)[1] == 15
    assert effective_rate(60, None, 15) == 12 and effective_rate(60, 100, 15) == 115 and effective_rate(60, 1, 15) == 3
    assert wait_before(3, 2, 120, False, 0) == 8 and wait_before(2, 2, 120, True, 0) == 18 and wait_before(9, 2, 1, True, 0) == 1


def test_config(tmp_path):
    base = '[generation]\nmain_topic = "T"\ndataset_mode = "dpo"\n%s\n[models.main]\nbase_url = "https://a.b/v1"\nmodel_name = "m"\ntemperature = 0.0\n[models.rejected]\nbase_url = "http://localhost:1"\nmodel_name = "r"\n'
    path = tmp_path / "c.toml"
    path.write_text(base % "over_generation_buffer = 0.0" + '[provider_rate_limits]\nopenai = 60\nprovider_burst_percent = 20\n')
    c = cfg.load(path)
    assert c.models["main"].temperature == 0.0 and c.generation.over_generation_buffer == 0.0 and c.generation.num_subtopics == 10 and c.provider_burst_percent == 20 and c.provider_rate_limits == {"openai": 60}
    for bad in ("concurrency = 2000", "num_subtopics = 0", "over_generation_buffer = 2.0", 'sft_format = "x"', "min_prompt_success_rate = 1.5"):
        path.write_text(base % bad)
        with pytest.raises(cfg.ConfigError):
            cfg.load(path)
    path.write_text(base % "concurrency = 2000\ndisable_limits = true")
    assert cfg.load(path).generation.concurrency == 2000
    for url in ("ftp://a", "http://", "x", "https://a.b"):
        assert cfg.valid_url(url) == (url == "https://a.b")
    (tmp_path / ".env").write_text("# c\nOPENAI_API_KEY='k1'\nexport API_KEY=\"k2\"\nPATH=/x\nbroken\n")
    env = cfg.read_env(tmp_path / ".env")
    assert env == {"OPENAI_API_KEY": "k1", "API_KEY": "k2"}
    s = cfg.Secrets(env)
    assert s.key_for("https://api.openai.com/v1") == "k1" and s.key_for("https://api.nvidia.com") == "k2" and cfg.Secrets({}).key_for("http://localhost") == ""


def test_sessions(tmp_path):
    for bad in ("", "../x", "/abs", "session_2025-10-30", "session_2025-10-30T14-30-00/..", "session_2025-10-30T14-30-00\n", "a\\b"):
        with pytest.raises(SessionError):
            check_name(bad, tmp_path)
    assert check_name("session_2025-10-30T14-30-00", tmp_path).name.startswith("session_")
    s = Session(tmp_path)
    s.logger().info("hello", extra={"fields": {"job_id": 3}})
    assert json.loads((s.folder / "session.log").read_text())["job_id"] == 3
    m = Manifest(s.name, "abc", "pairs")
    m.save(s.folder)
    assert Manifest.load(s.folder) == m
    m.check_resumable("abc")
    for h, phase in (("abd", "pairs"), ("abc", "complete")):
        with pytest.raises(SessionError):
            Manifest(s.name, "abc", phase).check_resumable(h)


def test_hub(tmp_path):
    (tmp_path / "dataset.jsonl").write_bytes(b"x" * 1000)
    plan = hub.upload(tmp_path, "me/data")
    assert [f[0] for f in plan["files"]] == [".gitattributes", "dataset.jsonl"] and len(plan["commit"].splitlines()) == 3
    assert hub.operation(tmp_path / "dataset.jsonl", "d", limit=1000).lfs and not hub.operation(tmp_path / "dataset.jsonl", "d", limit=1001).lfs
    assert hub.part_urls({"10": "b", "2": "a", "chunk_size": "5"}) == ["a", "b"]
    tries, waits = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert hub.with_retries(call, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
