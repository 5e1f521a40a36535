"""Completion providers: from a table, by an expression, or over HTTP.

A provider turns (job_id, prompt) into (job_id, content, reasoning_content, finish_reason, error, duration_ns, wait_ns), the last being what was waited for
the rate limit. Where a call failed, ``error`` says how and there is no content: an error's text is never a reply. Calls are costly and differ each time, so plans write down what a
provider returns before they use it.
"""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import count
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "job_id long, content string, reasoning_content string, finish_reason string, error string, duration_ns long, wait_ns long"
# Answers after which a call is repeated.
RETRYABLE = (429, 500, 502, 503, 504)


class Provider(Protocol):
    def complete(self, requests: DataFrame, stage: str) -> DataFrame: ...


def _no_call() -> list[Column]:
    """What stands for a call's outcome where nothing was called."""
    return [F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("duration_ns"), F.lit(0).cast("long").alias("wait_ns")]


def replies(provider: Provider, requests: DataFrame, stage: str) -> DataFrame:
    """What a provider returns, in the columns of SCHEMA; one that leaves some out has nulls there."""
    out = provider.complete(requests, stage)
    fields = [c.split() for c in SCHEMA.split(", ")]
    return out.select(*(F.col(name) if name in out.columns else F.lit(None).cast(kind).alias(name) for name, kind in fields))


def prompt_key(stage: Column, prompt: Column) -> Column:
    """What a recorded completion is found by."""
    return F.sha2(F.concat_ws("\x1f", stage, prompt), 256)


@dataclass
class Replay:
    """Completions recorded as (key, content, reasoning_content, finish_reason); a request without one is an error unless ``lenient``."""

    recorded: DataFrame
    lenient: bool = False

    def complete(self, requests: DataFrame, stage: str) -> DataFrame:
        out = requests.withColumn("key", prompt_key(F.lit(stage), F.col("prompt"))).join(self.recorded.withColumn("_hit", F.lit(True)), "key", "inner" if self.lenient else "left")
        content = F.col("content") if self.lenient else F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no recorded completion for job "), F.col("job_id").cast("string"))).cast("string")).otherwise(F.col("content"))
        return out.select("job_id", content.alias("content"), "reasoning_content", "finish_reason", *_no_call())


@dataclass
class Deterministic:
    """Completions by a Column expression of the prompt, for tests and dry runs."""

    expression: Callable[[Column, str], Column]
    reasoning: Callable[[Column, str], Column] | None = None

    def complete(self, requests: DataFrame, stage: str) -> DataFrame:
        reason = self.reasoning(F.col("prompt"), stage) if self.reasoning else F.lit(None).cast("string")
        return requests.select("job_id", self.expression(F.col("prompt"), stage).alias("content"), reason.alias("reasoning_content"), F.lit("stop").alias("finish_reason"), *_no_call())


class Bucket:
    """A token bucket: ``rate`` tokens a second, ``burst`` at once. Any number of threads may take from it."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()
        self.lock = threading.Lock()

    def take(self) -> float:
        """Wait for a token; the seconds waited."""
        with self.lock:
            now = self.clock()
            self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
            self.tokens -= 1
            wait = max(0.0, -self.tokens / self.rate)
        if wait:
            self.sleep(wait)
        return wait


def model_bucket(rpm: int) -> tuple[float, int]:
    """(tokens a second, burst) of a model's limit a minute."""
    return rpm / 60, max(5, rpm // 5)


def provider_bucket(rpm: int, percent: int) -> tuple[float, int]:
    """(tokens a second, burst) of a limit that all models of a provider share."""
    return rpm / 60, max(3, rpm * percent // 100)


def effective_rate(model_rpm: int, provider_rpm: int | None, percent: int) -> int:
    """How many requests may be under way at once."""
    return max(3, provider_rpm * (100 + percent) // 100) if provider_rpm else max(5, model_rpm // 5)


def wait_before(attempt: int, base: float, cap: float, limited: bool, jitter: float | None = None) -> float:
    """Seconds before a repetition: powers of two, of three after a rate limit, at most the cap, give or take a tenth."""
    attempt = min(attempt, 64)  # far beyond any cap
    wait = min((3.0**attempt if limited else 2.0 ** (attempt - 1)) * base, cap)
    return wait * (1 + 0.1 * (random.uniform(-1, 1) if jitter is None else jitter))


@dataclass(frozen=True)
class Reply:
    """What came of a request."""

    content: str | None
    reasoning: str | None
    finish: str | None
    error: str | None = None
    seconds: float = 0.0
    waited: float = 0.0


@dataclass
class Http:
    """An OpenAI-compatible endpoint, called from the tasks; each task has a share of the rate and a pool of threads.

    ``tasks`` of them run at once at most, as far as the cluster has room for them, and each has an equal share of the model's limit and of that
    of its provider, if there is one. A token is taken from both for each attempt. A task asks for ``rows`` replies at most: that many calls are
    repeated if it is lost. A call, with all of its attempts, takes no longer than ``deadline``, or that of its stage in ``deadlines``; without a number of
    ``attempts`` it is repeated until then. ``systems`` has system prompts by stage, before the one for all.
    """

    base_url: str
    model: str
    api_key: str = ""
    rpm: int = 60
    tasks: int = 4
    attempts: int | None = 3
    timeout: float = 120.0
    base_delay: float = 2.0
    max_delay: float = 120.0
    temperature: float = 0.7
    structure_temperature: float = 0.0
    max_tokens: int = 4096
    structured: tuple[str, ...] = ()
    stream: bool = False
    extra: dict = field(default_factory=dict)
    provider_rpm: int | None = None
    burst_percent: int = 15
    rows: int = 64
    deadline: float = 900.0
    system: str = ""
    systems: dict[str, str] = field(default_factory=dict)
    deadlines: dict[str, float] = field(default_factory=dict)
    top_p: float | None = None
    json_mode: bool = False

    def body(self, prompt: str, stage: str) -> dict:
        warm = self.structure_temperature if stage in self.structured and self.structure_temperature > 0 else self.temperature
        system = self.systems.get(stage) or self.system
        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        options = {**({} if self.top_p is None else {"top_p": self.top_p}), **({"response_format": {"type": "json_object"}} if self.json_mode else {})}
        return {"model": self.model, "messages": messages, "temperature": warm, "max_tokens": self.max_tokens, "stream": self.stream, **options, **self.extra}

    def call(self, prompt: str, stage: str, buckets: list[Bucket], sleep: Callable[[float], None] = time.sleep) -> Reply:
        """The outcome of one request, repeated as long as that may help and there is time."""
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(self.body(prompt, stage)).encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})})
        began, deadline, waited = time.monotonic(), self.deadlines.get(stage, self.deadline), 0.0
        for attempt in count(1):
            for bucket in buckets:
                waited += bucket.take()
            left = deadline - (time.monotonic() - began)
            if left <= 0:
                error = "no time left"
                break
            try:
                with urllib.request.urlopen(request, timeout=min(self.timeout, left)) as answer:
                    content, reasoning, finish = read_stream(answer, began + deadline) if self.stream else read_reply(json.loads(answer.read()))
                    return Reply(content, reasoning, finish, None, time.monotonic() - began, waited)
            except urllib.error.HTTPError as e:
                error, again, limited = f"status {e.code}", e.code in RETRYABLE, e.code == 429
            except OSError as e:
                error, again, limited = str(e) or type(e).__name__, True, False
            except ValueError as e:
                error, again, limited = f"unreadable reply: {e}", False, False
            if not again or attempt == self.attempts:
                break
            sleep(min(wait_before(attempt, self.base_delay, self.max_delay, limited), max(0.0, deadline - (time.monotonic() - began))))
        return Reply(None, None, None, error, time.monotonic() - began, waited)

    def buckets(self, share: int) -> list[Bucket]:
        """The model's bucket and its provider's, for one of ``share`` tasks."""
        limits = [model_bucket(self.rpm), *([provider_bucket(self.provider_rpm, self.burst_percent)] if self.provider_rpm else [])]
        return [Bucket(rate / share, max(1, burst // share)) for rate, burst in limits]

    def threads(self, share: int) -> int:
        return max(1, effective_rate(self.rpm, self.provider_rpm, self.burst_percent) // share)

    def complete(self, requests: DataFrame, stage: str) -> DataFrame:
        asked = requests.select("job_id", "prompt")
        parts = max(self.tasks, -(-asked.count() // self.rows))
        share = min(parts, self.tasks, requests.sparkSession.sparkContext.defaultParallelism)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            buckets, threads = self.buckets(share), self.threads(share)
            with ThreadPoolExecutor(threads) as pool:
                for batch in batches:
                    replies = list(pool.map(lambda p: self.call(p, stage, buckets), batch["prompt"].to_pylist()))
                    columns = [[r.content for r in replies], [r.reasoning for r in replies], [r.finish for r in replies], [r.error for r in replies]]
                    times = [[int(r.seconds * 1e9) for r in replies], [int(r.waited * 1e9) for r in replies]]
                    yield pa.RecordBatch.from_arrays([batch["job_id"], *(pa.array(c, pa.string()) for c in columns), *(pa.array(t, pa.int64()) for t in times)], ["job_id", "content", "reasoning_content", "finish_reason", "error", "duration_ns", "wait_ns"])

        return asked.repartition(parts).mapInArrow(run, SCHEMA)


def read_reply(reply: dict) -> tuple[str, str, str]:
    if not reply.get("choices"):
        raise ValueError("no choices")
    first = reply["choices"][0]
    message = first.get("message") or {}
    return message.get("content") or "", message.get("reasoning_content") or "", first.get("finish_reason") or ""


def read_stream(lines, until: float = float("inf")) -> tuple[str, str, str]:
    """Join the deltas of server-sent events up to the end mark; blank lines and bad JSON are skipped. An error if it is not over in time."""
    content, reasoning, finish = [], [], ""
    for raw in lines:
        if time.monotonic() > until:
            raise TimeoutError("the stream took too long")
        line = raw.decode("utf-8", "replace").strip()
        if not line.startswith("data: "):
            continue
        if (data := line[6:].strip()) == "[DONE]":
            break
        try:
            choice = (json.loads(data).get("choices") or [{}])[0]
        except ValueError:
            continue
        delta = choice.get("delta") or {}
        content.append(delta.get("content") or "")
        reasoning.append(delta.get("reasoning_content") or "")
        finish = choice.get("finish_reason") or finish
    return "".join(content), "".join(reasoning), finish
