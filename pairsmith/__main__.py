"""Command line: run, checkpoint list | inspect | resume | adopt, transform, stream, upload, benchmark, report sessions | reliability | providers | samples | benchmark."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.plans import reports, transforms
from pairsmith.plans.pipeline import Pipeline
from pairsmith.functions.naming import PROVIDERS
from pairsmith.sources import config as cfg
from pairsmith.sources import checkpoints, hub, jsonl
from pairsmith.sources.providers import Http
from pairsmith.sources.sessions import MANIFEST, Manifest, Session, check_name, config_hash, sessions
from pairsmith.sources.sinks import JsonLines
from pairsmith.sources.staging import is_written, written
from pairsmith.streaming.transforms import MODES, complete_replies, lines_of, transform_stream


def spark_session() -> SparkSession:
    return SparkSession.builder.appName("pairsmith").config("spark.speculation", "false").getOrCreate()


#: Where datasets are published unless HF_ENDPOINT says otherwise.
HUB = "https://huggingface.co"


def http(model: cfg.Model, secrets: cfg.Secrets, config: cfg.Config | None = None) -> Http:
    """A model's endpoint, with its own limit and that of its provider, which all models of the provider share."""
    limit = None
    if config is not None and (name := next((p for part, p in PROVIDERS if part in model.base_url), None)) in config.provider_rate_limits:
        sharing = sum(any(part in m.base_url and p == name for part, p in PROVIDERS) for m in config.models.values())
        limit = max(1, config.provider_rate_limits[name] // max(1, sharing))
    tasks = config.generation.concurrency if config is not None else 4
    # A judge is given less time for a call and its repetitions; -1 repetitions are as many as there is time for.
    judging = {stage: float(model.judge_timeout_seconds) for stage in ("judge", "judge_filter")}
    return Http(
        model.base_url, model.model_name, secrets.key_for(model.base_url), model.rate_limit_per_minute, tasks=tasks, attempts=None if model.max_retries < 0 else model.max_retries + 1,
        timeout=float(model.http_timeout_seconds), max_delay=model.max_backoff_seconds, temperature=model.temperature, structure_temperature=model.structure_temperature, max_tokens=model.max_output_tokens,
        structured=("subtopics", "prompts", "judge", "judge_filter"), stream=model.use_streaming, system=model.system_prompt, provider_rpm=limit,
        burst_percent=config.provider_burst_percent if config is not None else 15, systems=dict(config.system_prompts) if config is not None else {},
        deadline=max(900.0, 4.0 * model.http_timeout_seconds), deadlines=judging, top_p=model.top_p, json_mode=model.use_json_mode,
    )


def _common(command: argparse.ArgumentParser, output: bool = True) -> None:
    command.add_argument("--config", default="config.toml")
    command.add_argument("--env-file", "--env", default=".env", help="KEY=VALUE lines with secrets; the default need not be there")
    command.add_argument("--zero-is-unset", action="store_true", help="an explicit 0 in the configuration stands for the default")
    command.add_argument("-v", "--verbose", action="store_true")
    if output:
        command.add_argument("--output", default="output")


def _kept(command: argparse.ArgumentParser) -> None:
    command.add_argument("--csv", help="write the report as CSV to this folder")
    command.add_argument("--json", help="write the report to this file")
    command.add_argument("--markdown", help="write the report as a table to this file")


def _publishing(command: argparse.ArgumentParser) -> None:
    command.add_argument("--upload-to-hf", action="store_true", help="publish the dataset when it is made")
    command.add_argument("--hf-repo-id", "--upload", metavar="REPOSITORY", help="where to, else the configuration's")


def configured(a: argparse.Namespace) -> cfg.Config:
    """The configuration; what has no effect in it is told."""
    config = cfg.load(a.config, a.zero_is_unset)
    for note in config.notes:
        print(f"note: {note}", file=sys.stderr)
    if a.verbose:
        logging.getLogger("pairsmith").setLevel(logging.DEBUG)
    return config


def secrets_of(a: argparse.Namespace) -> cfg.Secrets:
    """Keys from the environment, and before it from a file; only the default file may be missing."""
    path = getattr(a, "env_file", None)
    there = path and (path != ".env" or Path(path).exists())
    return cfg.Secrets({**(cfg.read_env(path) if there else {}), **os.environ})


def repository_of(a: argparse.Namespace, config: cfg.Config) -> str | None:
    """Where to publish, if at all."""
    if not (a.upload_to_hf or a.hf_repo_id):
        return None
    if not (name := a.hf_repo_id or config.repository):
        raise SystemExit("no repository to publish to: name it with --hf-repo-id or in the configuration")
    return name


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pairsmith")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    _common(run)
    _publishing(run)
    run.add_argument("--tables", help="a place for tables that executors share, if they do not share the output folder")
    check = commands.add_parser("checkpoint").add_subparsers(dest="action", required=True)
    for name in ("list", "inspect", "resume", "adopt"):
        sub = check.add_parser(name)
        if name != "list":
            sub.add_argument("session")
        if name == "resume":
            _common(sub)
            _publishing(sub)
            sub.add_argument("--tables")
        else:
            sub.add_argument("--output", default="output")
    transform = commands.add_parser("transform")
    transform.add_argument("--mode", choices=("sft-to-dpo", "regen-rejected", "regen"), required=True)
    transform.add_argument("--input", help="JSONL without reasoning")
    transform.add_argument("--input-reasoning", help="JSONL of pairs with reasoning, for regen-rejected: it then is what prompts and chosen replies are taken from")
    transform.add_argument("--output", help="JSONL without reasoning")
    transform.add_argument("--output-reasoning", "--reasoning-output", help="JSONL of pairs that keep their rejected replies' reasoning")
    transform.add_argument("--format", choices=cfg.STYLES, help="of supervised records; else that of the configuration")
    transform.add_argument("--checkpoint", help="where replies are kept, else beside the output")
    transform.add_argument("--resume", action="store_true", help="go on with the replies that are kept; it is an error if there are none")
    _common(transform, output=False)
    stream = commands.add_parser("stream", help="transform the files of a folder as they arrive")
    stream.add_argument("--mode", choices=MODES, required=True)
    stream.add_argument("--input", required=True, help="a folder of JSONL files")
    stream.add_argument("--output", required=True, help="a folder for dataset, dataset_reasoning, rejects and replies")
    stream.add_argument("--checkpoint", help="else within the output")
    stream.add_argument("--format", choices=cfg.STYLES)
    stream.add_argument("--files", type=int, default=100, help="files of a batch at most")
    stream.add_argument("--forever", action="store_true", help="wait for more files")
    stream.add_argument("--gated", action="store_true", help="leave out pairs whose chosen reply does not pass the gates")
    _common(stream, output=False)
    upload = commands.add_parser("upload")
    upload.add_argument("repository")
    upload.add_argument("session")
    upload.add_argument("--output", default="output")
    upload.add_argument("--env-file", "--env", default=".env")
    upload.add_argument("--dry-run", action="store_true", help="print what would be sent")
    report = commands.add_parser("report")
    report.add_argument("kind", nargs="?", choices=reports.KINDS, default="sessions")
    report.add_argument("--output", default="output")
    report.add_argument("--least", type=int, default=1, help="leave out sessions with fewer jobs")
    report.add_argument("--last", type=int, default=20)
    _kept(report)
    bench = commands.add_parser("benchmark", help="run a configuration with several numbers of workers and compare them")
    bench.add_argument("--workers", default="8,16,24", help="numbers, with commas between them")
    bench.add_argument("--tables")
    _common(bench)
    _kept(bench)
    return top


def all_sessions(output: str) -> list[dict]:
    """Sessions of this library, then those of other tools that have a checkpoint and are not taken over yet; the last first."""
    own = sessions(output)
    if not any(Path(output).glob(f"*/{checkpoints.CHECKPOINT}")):
        return own
    found = checkpoints.progress_of(checkpoints.scan_checkpoints(spark_session(), f"{output}/*/{checkpoints.CHECKPOINT}"))
    known = {s["session"] for s in own}
    # One short row for each session, as in the list before.
    return own + [r.asDict() for r in found.orderBy(F.desc("session")).collect() if r.session not in known]


def inspected(folder: Path) -> dict:
    """A session's manifest, or what its checkpoint says."""
    if (folder / MANIFEST).exists() or not (folder / checkpoints.CHECKPOINT).exists():
        return vars(Manifest.load(folder))
    found = checkpoints.scan_checkpoints(spark_session(), str(folder / checkpoints.CHECKPOINT), strict=True)
    state = found.drop("subtopics", "prompts", "completed_job_ids", "session").first().asDict(recursive=True)
    return {**checkpoints.progress_of(found).first().asDict(), **state}


def check_resumable(session: Session, config: cfg.Config) -> None:
    """An error if the session cannot be resumed; one of another tool is taken over first."""
    g = config.generation
    if not (session.folder / MANIFEST).exists():
        checkpoints.adopt(spark_session(), session)
    Manifest.load(session.folder).check_resumable(config_hash(g.main_topic, g.num_subtopics, g.num_prompts_per_subtopic))


def generate(config: cfg.Config, session: Session, secrets: cfg.Secrets) -> dict:
    return Pipeline(spark_session(), config, session, {k: http(m, secrets, config) for k, m in config.models.items()}).run()


def publish(folder: Path, repository: str, secrets: cfg.Secrets, dry: bool = False) -> dict:
    """Send a session's files; without a token, or as a dry run, what would be sent."""
    token = secrets.keys["hub"]
    sent = hub.upload(folder, repository, None if dry or not token else hub.http_transport(token, os.environ.get("HF_ENDPOINT", HUB)))
    return {**{k: v for k, v in sent.items() if k != "commit"}, "sent": bool(token) and not dry}


def benchmark(a: argparse.Namespace, secrets: cfg.Secrets) -> None:
    """A session for each number of workers, and a report on them; the best comes last."""
    config, spark = configured(a), spark_session()
    started: dict[str, int] = {}

    def run(one: cfg.Config) -> dict:
        session = new_session(a.output, a.tables)
        session.keep_config(a.config)
        started[session.name] = one.generation.concurrency
        generate(one, session, secrets)
        times = reports.benchmark(spark, a.output, spark.createDataFrame([(session.name,)], "session string")).drop("workers").first()
        return times.asDict() if times else {"session": session.name, "throughput": 0.0}

    results = reports.sweep(config, [int(w) for w in a.workers.split(",")], run)
    fields = ("workers", "session", "jobs", "duration_s", "throughput", "total_ms", "wait_ms", "blocking", "error")
    kinds = ("long", "string", "long", "double", "double", "double", "double", "double", "string")
    table = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in results], ", ".join(f"{f} {k}" for f, k in zip(fields, kinds, strict=True)))
    rows = reports.save(table, a.csv, a.json, a.markdown)
    print(reports.markdown(list(fields), rows), end="")
    if best := reports.best_of(results):
        print(f"best: {best['workers']} workers, {best['throughput']:.2f} jobs a minute")


def new_session(output: str, tables: str | None) -> Session:
    """A session of its own: names are by the second."""
    while True:
        try:
            return Session(output, tables=tables)
        except FileExistsError:
            time.sleep(0.2)


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    secrets = secrets_of(a)
    if a.command == "run":
        config = configured(a)
        repository, before = repository_of(a, config), config.generation.resume_from_session
        session = Session(a.output, before or None, tables=a.tables)
        if before:
            check_resumable(session, config)
        else:
            session.keep_config(a.config)
        print(json.dumps(generate(config, session, secrets)))
        if repository:
            print(json.dumps(publish(session.folder, repository, secrets)))
    elif a.command == "checkpoint" and a.action == "list":
        print(json.dumps(all_sessions(a.output), indent=1))
    elif a.command == "checkpoint" and a.action == "inspect":
        print(json.dumps(inspected(check_name(a.session, Path(a.output))), indent=1))
    elif a.command == "checkpoint" and a.action == "adopt":
        print(json.dumps(vars(checkpoints.adopt(spark_session(), Session(a.output, a.session))), indent=1))
    elif a.command == "checkpoint":
        config = configured(a)
        repository, session = repository_of(a, config), Session(a.output, a.session, tables=a.tables)
        check_resumable(session, config)
        print(json.dumps(generate(config, session, secrets)))
        if repository:
            print(json.dumps(publish(session.folder, repository, secrets)))
    elif a.command == "upload":
        print(json.dumps(publish(check_name(a.session, Path(a.output)), a.repository, secrets, a.dry_run)))
    elif a.command == "transform":
        transform(a, secrets)
    elif a.command == "stream":
        config = configured(a)
        provider = http(config.models["rejected"], secrets, config)
        query = transform_stream(
            lines_of(spark_session(), a.input, a.files), a.mode, provider, a.output, a.checkpoint or f"{a.output}/checkpoint", a.format or config.generation.sft_format,
            config.prompt_templates.get("rejected"), a.forever, complete_replies if a.gated else None,
        )
        query.awaitTermination()
    elif a.command == "benchmark":
        benchmark(a, secrets)
    else:
        out = reports.report(spark_session(), a.kind, a.output, a.least, a.last)
        print(reports.markdown(out.columns, reports.save(out, a.csv, a.json, a.markdown)), end="")
    return 0


def transform(a: argparse.Namespace, secrets: cfg.Secrets) -> None:
    """Run a transform. Replies are kept beside the output, so that one that failed or was stopped goes on where it was; outputs are made as a whole."""
    regen = a.mode != "sft-to-dpo"
    inputs, outputs = [p for p in (a.input, a.input_reasoning) if p], [p for p in (a.output, a.output_reasoning) if p]
    # A wrong path is an error before anything is asked.
    if not regen and (not a.input or not a.output or a.input_reasoning or a.output_reasoning):
        raise SystemExit("this transform has one input and one output, without reasoning")
    if not inputs or not outputs:
        raise SystemExit("an input and an output are wanted")
    if a.output_reasoning and not a.input_reasoning:
        raise SystemExit("an output with reasoning wants an input with reasoning")
    if len({*inputs, *outputs}) < len(inputs) + len(outputs):
        raise SystemExit("inputs and outputs must be different paths")
    config = configured(a)
    if "rejected" not in config.models:
        raise SystemExit("models.rejected is missing")
    spark, provider = spark_session(), http(config.models["rejected"], secrets, config)
    ledger, text = a.checkpoint or f"{outputs[0]}.replies", config.prompt_templates.get("rejected")
    if a.resume and not transforms.has_replies(spark, ledger):
        raise SystemExit(f"no replies to go on with: {ledger}")
    if taken := [p for p in outputs if is_written(spark, p)]:
        raise SystemExit(f"there already: {', '.join(taken)}")
    if not regen:
        rows = transforms.sft_to_dpo(jsonl.scan_sft(spark, a.input), a.format or config.generation.sft_format, provider, ledger=ledger, text=text)
        JsonLines(a.output, overwrite=True).write(in_order(rows, "line_no"))
    elif a.input_reasoning:
        plain, reasoned = transforms.regen_rejected(jsonl.scan_dpo(spark, a.input_reasoning, validate=False), provider, ledger=ledger, text=text)
        if a.output_reasoning:
            JsonLines(a.output_reasoning, overwrite=True).write(in_order(reasoned, "job_id"))
        if a.output:
            JsonLines(a.output, overwrite=True).write(in_order(plain, "job_id"))
    else:
        rows = transforms.regen_plain(jsonl.scan_dpo(spark, a.input), provider, ledger=ledger, text=text)
        JsonLines(a.output, overwrite=True).write(in_order(rows, "job_id"))


def in_order(rows: DataFrame, line: str) -> DataFrame:
    """By the lines that they come from, in range partitions; without the number."""
    return written(rows).orderBy(line).drop(line)


if __name__ == "__main__":
    sys.exit(main())
