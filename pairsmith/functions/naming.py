"""Names, hashes and small numbers of a run."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A provider is told by a part of its URL; the first that fits counts.
PROVIDERS = (
    ("openai.com", "openai"),
    ("nvidia.com", "nvidia"),
    ("anthropic.com", "anthropic"),
    ("together.xyz", "together"),
    ("together.ai", "together"),
    ("llm.chutes.ai", "chutes"),
    ("ai.nahcrof.com", "nahcrof"),
)
LOCAL_HOSTS = ("://127.0.0.1", "://localhost", "://[::1]", "://0.0.0.0")
SESSION_NAME = re.compile(r"session_\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}\Z")


def provider_name(url: Column, providers: tuple[tuple[str, str], ...] = PROVIDERS) -> Column:
    """The provider of a URL, else the URL itself: a chain of conditions, so it needs no join."""
    chain = reduce(lambda c, p: c.when(F.contains(url, F.lit(p[0])), F.lit(p[1])), providers[1:], F.when(F.contains(url, F.lit(providers[0][0])), F.lit(providers[0][1])))
    return chain.otherwise(url)


def is_local_endpoint(url: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(url, F.lit(h)) for h in LOCAL_HOSTS))


def config_hash(topic: Column, subtopics: Column, prompts: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over what makes two runs comparable."""
    return F.substring(F.sha2(F.concat_ws(":", topic, subtopics.cast("string"), prompts.cast("string")), 256), 1, 16)


def session_name(started: Column) -> Column:
    return F.concat(F.lit("session_"), F.date_format(started, "yyyy-MM-dd'T'HH-mm-ss"))


def over_request(target: int, buffer: float) -> int:
    """How many to ask for so that enough are left: the product in floating point, cut to an integer."""
    return int(target * (1 + buffer))


def backoff(attempt: Column, base: float, cap: float, rate_limited: Column) -> Column:
    """Seconds before attempt ``attempt`` (from 1) is repeated: powers of two, of three where the rate was limited, up to a cap."""
    wait = F.when(rate_limited, F.pow(F.lit(3.0), attempt) * base).otherwise(F.pow(F.lit(2.0), attempt - 1) * base)
    return F.least(wait, F.lit(float(cap)))


def chunk_size(chunk: Column, total: int, size: int) -> Column:
    """The length of the chunk-th request (from 0) of a total asked for in chunks."""
    return F.least(F.lit(size), F.lit(total) - chunk * size)
