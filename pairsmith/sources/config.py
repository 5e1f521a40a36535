"""Configuration: TOML files, defaults, bounds, environment files and secrets. All of it lives on the driver.

Templates and system prompts are held by the stage that they are for. A key that nothing reads is told, not passed over in silence.
"""

from __future__ import annotations

import os
import re
import tomllib
import unicodedata
from dataclasses import dataclass, field, fields
from pathlib import Path
from urllib.parse import urlsplit

from pairsmith.functions import template
from pairsmith.functions.naming import PROVIDERS

MAX_CONFIG, MAX_ENV, MAX_TEMPLATE = 10 << 20, 100 << 10, 50 << 10
MAX_TOPIC, MAX_MODEL, MAX_RETRIES = 500, 100, 5
MODES = ("sft", "dpo", "kto", "mo-dpo")
STYLES = ("alpaca", "sharegpt")
# The environment variables that are read from a file, and those with secrets.
KEY_VARIABLES = {"openai": ("OPENAI_API_KEY",), "nvidia": ("NVIDIA_API_KEY",), "anthropic": ("ANTHROPIC_API_KEY",), "together": ("TOGETHER_API_KEY",), "chutes": ("CHUTES_API_KEY",), "nahcrof": ("NAHCROF_API_KEY",), "generic": ("API_KEY",), "hub": ("HUGGING_FACE_TOKEN", "HUGGINGFACE_TOKEN", "HF_TOKEN")}


# The names under which files have the templates and the system prompts of the stages.
TEMPLATE_KEYS = {"subtopic_generation": "subtopics", "prompt_generation": "prompts", "chosen_generation": "chosen", "rejected_generation": "rejected", "judge_rubric": "judge"}
SYSTEM_KEYS = {"subtopic_system_prompt": ("subtopics",), "prompt_system_prompt": ("prompts",), "chosen_system_prompt": ("chosen",), "rejected_system_prompt": ("rejected",), "judge_system_prompt": ("judge", "judge_filter")}
#: What a template may name: by stage, each under all of its names.
FIELDS = {
    "subtopics": ("MainTopic", "NumSubtopics", "Count", "IsRetry", "ExcludeSubtopics", "Exclude"),
    "prompts": ("MainTopic", "SubTopic", "NumPrompts", "Count"),
    "chosen": ("Prompt", "MainTopic", "SubTopic"),
    "rejected": ("Prompt", "MainTopic", "SubTopic"),
    "judge": ("Prompt", "StoryText", "Reply", "Criteria"),
    "judge_filter": ("Prompt", "StoryText", "Reply", "Criteria"),
}
#: Earlier names of keys.
RENAMED = {"min_prompt_success_rate": "min_success_rate", "disable_limits": "disable_validation_limits"}


class ConfigError(ValueError):
    """The configuration cannot be used."""


@dataclass
class Model:
    base_url: str = ""
    model_name: str = ""
    temperature: float = 0.7
    structure_temperature: float = 0.0
    top_p: float = 1.0
    max_output_tokens: int = 4096
    context_size: int = 0
    rate_limit_per_minute: int = 60
    #: Repetitions of a call; -1: as long as there is time.
    max_retries: int = 3
    max_backoff_seconds: int = 120
    http_timeout_seconds: int = 120
    judge_timeout_seconds: int = 100
    use_json_mode: bool = False
    use_streaming: bool = False
    system_prompt: str = ""
    enabled: bool = True


@dataclass
class Generation:
    main_topic: str = ""
    num_subtopics: int = 10
    num_prompts_per_subtopic: int = 5
    subtopic_chunk_size: int = 30
    concurrency: int = 8
    over_generation_buffer: float = 0.15
    max_exclusion_list_size: int = 50
    dataset_mode: str = "mo-dpo"
    sft_format: str = "sharegpt"
    include_topic_columns: bool = False
    enable_reasoning_capture: bool = False
    reasoning_capture_rejected: bool = False
    prompt_retry_attempts: int = 2
    min_success_rate: float = 0.9
    disable_validation_limits: bool = False
    resume_from_session: str = ""
    # A run can always be resumed, from its last written slice: these two change nothing.
    enable_checkpointing: bool = True
    checkpoint_interval: int = 10


@dataclass
class JudgeFiltering:
    enabled: bool = False
    use_explanations: bool = False
    min_chosen_score: float = 4.0
    max_rejected_score: float = 3.0


@dataclass
class Config:
    generation: Generation = field(default_factory=Generation)
    models: dict[str, Model] = field(default_factory=dict)
    prompt_templates: dict[str, str] = field(default_factory=dict)
    judge_filtering: JudgeFiltering = field(default_factory=JudgeFiltering)
    provider_rate_limits: dict[str, int] = field(default_factory=dict)
    provider_burst_percent: int = 15
    #: By stage, as are the templates above.
    system_prompts: dict[str, str] = field(default_factory=dict)
    #: The repository that a dataset is published to if none is named.
    repository: str = ""
    #: What the file has that has no effect.
    notes: list[str] = field(default_factory=list)


def _fill(kind, values: dict, where: str, notes: list[str], zero_is_unset: bool = False):
    """A dataclass of the values; a field that is not given keeps its default, and so does, with ``zero_is_unset``, one that is 0 or empty."""
    if not isinstance(values, dict):
        raise ConfigError(f"{where} must be a table")
    known, out = {f.name: type(f.default) for f in fields(kind)}, {}
    for key, value in values.items():
        name = RENAMED.get(key, key)
        if name not in known:
            notes.append(f"{where}.{key} is unknown")
            continue
        wanted = known[name]
        # A whole number will do for a float; a bool is no number.
        if not (isinstance(value, wanted) and isinstance(value, bool) == (wanted is bool) or wanted is float and isinstance(value, int) and not isinstance(value, bool)):
            raise ConfigError(f"{where}.{key} must be {wanted.__name__}")
        if not (zero_is_unset and not isinstance(value, bool) and value in (0, "")):
            out[name] = value
    return kind(**out)


def _by_stage(values: dict, notes: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Templates and system prompts by stage, empty ones left out: an empty one is the default."""
    templates, systems = {}, {}
    for key, text in values.items():
        if not isinstance(text, str):
            raise ConfigError(f"prompt_templates.{key} must be text")
        if len(text.encode()) > MAX_TEMPLATE:
            raise ConfigError(f"prompt_templates.{key} is too large")
        stage = TEMPLATE_KEYS.get(key, key)
        if key not in SYSTEM_KEYS and stage not in FIELDS:
            notes.append(f"prompt_templates.{key} is unknown")
        elif text and key in SYSTEM_KEYS:
            systems |= dict.fromkeys(SYSTEM_KEYS[key], text)
        elif text:
            templates[stage] = text
    return templates, systems


def load(path: str | Path, zero_is_unset: bool = False) -> Config:
    """Read, fill in and check a TOML file of at most 10 MB.

    An explicit 0 counts, unless ``zero_is_unset``: then 0 and empty text stand for the default, as files written for tools that cannot tell them apart
    may expect.
    """
    path = Path(path)
    if path.stat().st_size > MAX_CONFIG:
        raise ConfigError("the file is too large")
    try:
        raw = tomllib.loads(path.read_text())
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    limits = dict(raw.get("provider_rate_limits", {}))
    # The percentage is a key of its own; inside the table of limits, as some files have it, it is no provider.
    percent = raw.get("provider_burst_percent", limits.pop("provider_burst_percent", 15))
    notes = [f"{k} is unknown" for k in raw if k not in ("generation", "models", "prompt_templates", "judge_filtering", "provider_rate_limits", "provider_burst_percent", "huggingface")]
    fill = lambda kind, values, where: _fill(kind, values, where, notes, zero_is_unset)
    templates, systems = _by_stage(raw.get("prompt_templates", {}), notes)
    models = {k: fill(Model, v, f"models.{k}") for k, v in raw.get("models", {}).items()}
    hub = raw.get("huggingface", {})
    notes += [f"huggingface.{k} is unknown" for k in hub if k != "repo_id"]
    config = Config(
        fill(Generation, raw.get("generation", {}), "generation"), models, templates, fill(JudgeFiltering, raw.get("judge_filtering", {}), "judge_filtering"),
        limits, 15 if zero_is_unset and not percent else percent, systems, hub.get("repo_id", ""), notes,
    )
    check(config)
    if config.judge_filtering.use_explanations:
        notes.append("judge_filtering.use_explanations changes nothing: filtering asks for scores only")
    if config.judge_filtering.enabled and config.generation.dataset_mode == "mo-dpo":
        notes.append("judge_filtering is not applied in the multi-objective mode, which has all scores")
    return config


def check(config: Config) -> None:
    """Raise ConfigError for the first value out of bounds."""
    g = config.generation
    top = 10**9 if g.disable_validation_limits else None
    rules = [
        (has_text(g.main_topic) and len(g.main_topic.encode()) <= MAX_TOPIC and not control_characters(g.main_topic), "main_topic must have 1 to 500 bytes and no control characters"),
        (1 <= g.num_subtopics <= (top or 10_000), "num_subtopics"),
        (1 <= g.num_prompts_per_subtopic <= (top or 10_000), "num_prompts_per_subtopic"),
        (1 <= g.concurrency <= (top or 1024), "concurrency"),
        (g.subtopic_chunk_size >= 0, "subtopic_chunk_size"),
        (0 <= g.over_generation_buffer <= 1, "over_generation_buffer"),
        (0 <= g.min_success_rate <= 1, "min_success_rate"),
        (0 <= g.prompt_retry_attempts <= (top or MAX_RETRIES), "prompt_retry_attempts"),
        (g.max_exclusion_list_size >= 0, "max_exclusion_list_size"),
        (g.dataset_mode in MODES, "dataset_mode"),
        (g.sft_format in STYLES, "sft_format"),
        (1 <= config.provider_burst_percent <= 50, "provider_burst_percent must be between 1 and 50"),
        ("main" in config.models, "models.main is missing"),
        (g.dataset_mode == "sft" or "rejected" in config.models, "models.rejected is missing"),
    ]
    f = config.judge_filtering
    judged = g.dataset_mode == "mo-dpo" or f.enabled
    rules += [(not judged or "judge" in config.models and config.models["judge"].enabled, "models.judge is missing or not enabled"), (not f.enabled or (1 <= f.min_chosen_score <= 5 and 1 <= f.max_rejected_score <= 5), "judge scores must be between 1 and 5")]
    for name, m in config.models.items():
        if name == "judge" and not m.enabled:
            continue  # it is not asked
        rules += [
            (valid_url(m.base_url), f"models.{name}.base_url must be http or https with a host"),
            (has_text(m.model_name) and len(m.model_name.encode()) <= MAX_MODEL and not control_characters(m.model_name), f"models.{name}.model_name"),
            (0 <= m.temperature <= 2 and 0 <= m.structure_temperature <= 2, f"models.{name}.temperature"),
            (0 <= m.top_p <= 1, f"models.{name}.top_p"),
            (m.http_timeout_seconds > 0 and m.judge_timeout_seconds > 0, f"models.{name}: timeouts must be positive"),
            (m.max_output_tokens > 0 and (not m.context_size or m.max_output_tokens <= m.context_size), f"models.{name}.max_output_tokens"),
            (m.rate_limit_per_minute > 0, f"models.{name}.rate_limit_per_minute"),
            (m.max_retries >= -1 and m.max_backoff_seconds >= 0, f"models.{name}.max_retries"),
        ]
    for good, what in rules:
        if not good:
            raise ConfigError(what)
    for stage, text in config.prompt_templates.items():
        try:
            unknown = template.names(text) - set(FIELDS[stage])
        except template.TemplateError as e:
            raise ConfigError(f"the template of {stage}: {e}") from e
        if unknown:
            raise ConfigError(f"the template of {stage} has no field {', '.join(sorted(unknown))}")


def has_text(value: str) -> bool:
    return bool(value and value.strip())


def control_characters(value: str) -> bool:
    """Control characters other than line feed, tab and carriage return."""
    return any(unicodedata.category(c) == "Cc" and c not in "\n\t\r" for c in value)


def valid_url(url: str) -> bool:
    try:
        parts = urlsplit(url)
        return parts.scheme in ("http", "https") and bool(parts.hostname)
    except ValueError:
        return False


ENV_LINE = re.compile(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*\Z")


def read_env(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines of a file of at most 100 KB; comments and blank lines are skipped, enclosing quotes go, only names with secrets count."""
    path = Path(path)
    if path.stat().st_size > MAX_ENV:
        raise ConfigError("the environment file is too large")
    allowed, out = {v for names in KEY_VARIABLES.values() for v in names}, {}
    for line in path.read_text().splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = ENV_LINE.match(line)
        if m and m.group(1) in allowed:
            value = m.group(2)
            out[m.group(1)] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


class Secrets:
    """Keys by provider, from a mapping such as the environment."""

    def __init__(self, environment: dict[str, str] | None = None) -> None:
        env = os.environ if environment is None else environment
        self.keys = {name: next((env[v] for v in variables if env.get(v)), "") for name, variables in KEY_VARIABLES.items()}

    def key_for(self, url: str) -> str:
        """The provider's own key, else the generic one, else none: a local server needs none."""
        return next((self.keys[p] for part, p in PROVIDERS if part in url and self.keys.get(p)), self.keys["generic"])
