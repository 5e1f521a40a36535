"""Session folders and the manifests that make runs resumable."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import re
import shutil
import sys
import time
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pairsmith.functions.naming import SESSION_NAME

PHASES = ("subtopics", "prompts", "pairs", "complete")
MANIFEST = "manifest.json"


class SessionError(ValueError):
    """A session's name or state cannot be used."""


def check_name(name: str, root: Path) -> Path:
    """The folder of a session by name: a plain name of the right form, inside the root."""
    if not name or "/" in name or "\\" in name or ".." in name or os.path.isabs(name) or not SESSION_NAME.match(name):
        raise SessionError(f"bad session name: {name!r}")
    folder = (root / name).resolve()
    if folder.parent != root.resolve():
        raise SessionError("the session is outside of the output folder")
    return folder


@dataclass
class Manifest:
    """What a session has done; rows that are done are told from what is written, not from here."""

    session: str
    config_hash: str
    phase: str = "subtopics"
    created_at: str = ""
    saved_at: str = ""
    stats: dict = field(default_factory=dict)
    failed_subtopics: list[str] = field(default_factory=list)
    prompt_success_rate: float | None = None

    def save(self, folder: Path) -> None:
        """Written aside, then renamed: a reader sees the old or the new one."""
        self.saved_at = datetime.now(UTC).isoformat()
        aside = folder / f".{MANIFEST}.tmp"
        aside.write_text(json.dumps(asdict(self), indent=1))
        os.replace(aside, folder / MANIFEST)

    @staticmethod
    def load(folder: Path) -> Manifest:
        try:
            return Manifest(**json.loads((folder / MANIFEST).read_text()))
        except (OSError, ValueError, TypeError) as e:
            raise SessionError(f"no readable manifest in {folder}") from e

    def check_resumable(self, config_hash: str) -> None:
        if self.phase == "complete":
            raise SessionError("the session is complete")
        if self.config_hash != config_hash:
            raise SessionError("the configuration has changed")


def config_hash(topic: str, subtopics: int, prompts: int) -> str:
    return hashlib.sha256(f"{topic}:{subtopics}:{prompts}".encode()).hexdigest()[:16]


class Session:
    """A folder ``session_<time>`` with the manifest, a copy of the configuration, a log and one table for each phase.

    The folder is the driver's; where executors do not share it, ``tables`` names a place that they do, for the tables.
    """

    def __init__(self, root: str | Path, name: str | None = None, now: datetime | None = None, tables: str | None = None) -> None:
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)
        if name is None:
            name = (now or datetime.now()).strftime("session_%Y-%m-%dT%H-%M-%S")
            self.folder = check_name(name, self.root)
            self.folder.mkdir()
        else:
            self.folder = check_name(name, self.root)
            if not self.folder.is_dir():
                raise SessionError(f"no session {name}")
        self.name = name
        self.tables = f"{tables.rstrip('/')}/{name}" if tables else str(self.folder)

    def path(self, *parts: str) -> str:
        return "/".join([self.tables, *parts])

    def log(self, message: str, **fields: object) -> None:
        self.logger().info(message, extra={"fields": fields})

    def keep_config(self, source: str | Path) -> None:
        shutil.copyfile(source, self.folder / "config.toml.bak")

    def logger(self) -> logging.Logger:
        """Text on standard output, JSON lines in the session's log."""
        out = logging.getLogger(f"pairsmith.{self.name}")
        out.setLevel(logging.DEBUG)
        if not out.handlers:
            screen, lines = logging.StreamHandler(sys.stdout), logging.FileHandler(self.folder / "session.log")
            screen.setLevel(logging.INFO)
            lines.setFormatter(JsonFormatter())
            out.addHandler(screen)
            out.addHandler(lines)
        return out


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        moment = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created))
        return json.dumps({"time": f"{moment}Z", "level": record.levelname, "msg": record.getMessage(), **getattr(record, "fields", {})})


def sessions(root: str | Path) -> list[dict]:
    """What sessions there are, the last first, with phase and statistics; folders without a manifest are skipped."""
    out = []
    for folder in sorted(Path(root).glob("session_*"), reverse=True):
        if re.fullmatch(SESSION_NAME, folder.name) and (folder / MANIFEST).exists():
            m = Manifest.load(folder)
            out.append({"session": folder.name, "phase": m.phase, "saved_at": m.saved_at, **m.stats})
    return out
