"""Publishing a session's files to a dataset hub: the commit's lines, large-file pointers and parts. Nothing is sent unless a transport is given."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LFS_FROM = 10 << 20
SAMPLE = 200
# Which files the hub keeps as large ones.
GITATTRIBUTES = "".join(f"*.{kind} filter=lfs diff=lfs merge=lfs -text\n" for kind in ("jsonl", "parquet", "bin"))


@dataclass
class Operation:
    """One file of a commit: inline below 10 MB, else by digest and size."""

    path: str
    size: int
    sha256: str
    content: str | None
    sample: str

    @property
    def lfs(self) -> bool:
        return self.content is None

    def line(self) -> dict:
        if self.lfs:
            return {"key": "lfsFile", "value": {"path": self.path, "algo": "sha256", "oid": self.sha256, "size": self.size}}
        return {"key": "file", "value": {"path": self.path, "content": self.content, "encoding": "base64"}}


def operation(path: str | Path, name: str, limit: int = LFS_FROM) -> Operation:
    """Prepared in one pass over the file, a block at a time."""
    digest, size, head, blocks = hashlib.sha256(), 0, b"", []
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
            size += len(block)
            head = head or block[:SAMPLE]
            if size < limit:
                blocks.append(block)
    inline = base64.b64encode(b"".join(blocks)).decode() if size < limit else None
    return Operation(name, size, digest.hexdigest(), inline, base64.b64encode(head).decode())


def plan_of(content: Column, limit: int = LFS_FROM) -> Column:
    """struct(size, oid, lfs, sample) of a file's bytes: what a commit needs to know of it before anything is sent."""
    size = F.octet_length(content).cast("long")
    plain = lambda c: F.translate(F.base64(c), "\r\n", "")
    return F.struct(size.alias("size"), F.sha2(content, 256).alias("oid"), (size >= limit).alias("lfs"), plain(F.substring(content, 1, SAMPLE)).alias("sample"))


def planned(spark: SparkSession, path: str, limit: int = LFS_FROM) -> DataFrame:
    """(path, size, oid, lfs, sample) of the files at ``path``, read by the tasks: for datasets of many parts, each of which fits one."""
    return spark.read.format("binaryFile").load(path).select("path", plan_of(F.col("content"), limit).alias("p")).select("path", "p.*")


def attributes() -> Operation:
    raw = GITATTRIBUTES.encode()
    return Operation(".gitattributes", len(raw), hashlib.sha256(raw).hexdigest(), base64.b64encode(raw).decode(), base64.b64encode(raw[:SAMPLE]).decode())


def commit_body(summary: str, operations: list[Operation]) -> str:
    """The commit as lines of JSON: a header, then a line for each file."""
    head = {"key": "header", "value": {"summary": summary, "description": ""}}
    return "".join(json.dumps(x) + "\n" for x in [head, *(o.line() for o in operations)])


def batch_request(operations: list[Operation]) -> dict:
    return {"operation": "upload", "transfers": ["basic", "multipart"], "hash_algo": "sha_256", "objects": [{"oid": o.sha256, "size": o.size} for o in operations if o.lfs]}


def part_urls(header: dict[str, str]) -> list[str]:
    """The upload addresses of a multipart header: those with numeric keys, in the order of the numbers."""
    return [header[k] for k in sorted((k for k in header if re.fullmatch(r"\d+", k)), key=int)]


def with_retries(call: Callable[[], object], retries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; it is repeated after 2, 4, 8 ... seconds on OSError."""
    for attempt in range(retries + 1):
        try:
            return call()
        except OSError:
            if attempt == retries:
                raise
            sleep(base * 2**attempt)


class HubError(RuntimeError):
    """The hub refused a request."""


def http_transport(token: str, host: str, timeout: float = 300.0) -> Callable[[str, str, bytes], dict]:
    """Requests to a hub: paths go to the host with the token, whole addresses (of uploads) as they are. Busy answers are OSErrors, so they are repeated."""

    def send(method: str, target: str, body: bytes) -> dict:
        own = target.startswith("/")
        headers = {"Authorization": f"Bearer {token}"} if own else {}
        if own:
            headers["Content-Type"] = "application/vnd.git-lfs+json" if "/info/lfs/" in target else "application/x-ndjson" if "/commit/" in target else "application/json"
        try:
            with urllib.request.urlopen(urllib.request.Request(host.rstrip("/") + target if own else target, body, headers, method=method), timeout=timeout) as answer:
                raw = answer.read()
                return {**(json.loads(raw) if raw.strip().startswith(b"{") else {}), **({"etag": answer.headers["ETag"]} if answer.headers.get("ETag") else {})}
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise OSError(f"status {e.code}") from e
            if e.code == 409 and target.endswith("/repos/create"):  # it is there already
                return {}
            raise HubError(f"{method} {target.split('?')[0]}: status {e.code}") from e

    return send


def files_of(folder: str | Path, names: tuple[str, ...]) -> list[tuple[Path, str]]:
    """(file, name in the repository): plain files, and the parts of datasets that were written as folders."""
    out = []
    for name in names:
        path = Path(folder) / name
        if path.is_dir():
            parts = sorted(p for p in path.glob("part-*") if p.stat().st_size)
            stem, _, kind = name.rpartition(".")
            out += [(p, name if len(parts) == 1 else f"{stem}-{k:05}-of-{len(parts):05}.{kind}") for k, p in enumerate(parts)]
        elif path.is_file():
            out.append((path, name))
    return out


def upload(folder: str | Path, repository: str, transport: Callable[[str, str, bytes], dict] | None = None, names: tuple[str, ...] = ("dataset.jsonl", "dataset_reasoning.jsonl", "config.toml.bak"), sleep: Callable[[float], None] = time.sleep) -> dict:
    """Commit a session's datasets, configuration and the attributes; without a transport, what would be sent. An existing repository is never deleted."""
    found = files_of(folder, names)
    if not any(name.startswith("dataset") for _, name in found):
        raise HubError(f"no dataset in {folder}")
    operations = [attributes(), *(operation(path, name) for path, name in found)]
    plan = {"repository": repository, "files": [(o.path, o.size, o.lfs) for o in operations], "commit": commit_body("Add dataset", operations), "lfs": batch_request(operations)}
    if transport is None:
        return plan
    owner, _, short = repository.rpartition("/")
    create = {"name": short, "type": "dataset", **({"organization": owner} if owner else {})}
    with_retries(lambda: transport("POST", "/api/repos/create", json.dumps(create).encode()), sleep=sleep)
    large = {o.sha256: path for o, (path, _) in zip(operations[1:], found, strict=True) if o.lfs}
    if large:
        answer = with_retries(lambda: transport("POST", f"/datasets/{repository}.git/info/lfs/objects/batch", json.dumps(plan["lfs"]).encode()), sleep=sleep)
        for entry in answer.get("objects", []):
            if "error" in entry:
                raise HubError(f"{entry['oid']}: {entry['error'].get('message', 'refused')}")
            _send(large[entry["oid"]], entry, transport, sleep)
    done = with_retries(lambda: transport("POST", f"/api/datasets/{repository}/commit/main", plan["commit"].encode()), sleep=sleep)
    return {**plan, "answer": done}


def _send(path: Path, entry: dict, transport: Callable[[str, str, bytes], dict], sleep: Callable[[float], None] = time.sleep) -> None:
    """One large file: whole, or in parts of the size that the hub names; nothing if the hub has it. A part is in memory at a time."""
    actions = entry.get("actions", {})
    action = actions.get("upload")
    if not action:
        return
    header = action.get("header", {})
    urls = part_urls(header)
    if not urls:
        import mmap

        with path.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as whole:
            with_retries(lambda: transport("PUT", action["href"], whole), sleep=sleep)
    else:
        size, parts = int(header["chunk_size"]), []
        with path.open("rb") as f:
            for number, url in enumerate(urls, 1):
                data = f.read(size)
                tag = with_retries(lambda u=url, d=data: transport("PUT", u, d), sleep=sleep)
                parts.append({"partNumber": number, "etag": tag.get("etag", "")})
        with_retries(lambda: transport("POST", action["href"], json.dumps({"oid": entry["oid"], "parts": parts}).encode()), sleep=sleep)
    if "verify" in actions:
        with_retries(lambda: transport("POST", actions["verify"]["href"], json.dumps({"oid": entry["oid"], "size": entry["size"]}).encode()), sleep=sleep)
