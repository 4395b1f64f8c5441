"""A stream of what changes in a folder of source files: files that are added, edited and deleted.

The stream's offset names a manifest (path, time of change, size, SHA-256), kept as a file in the state folder;
a batch is the difference of two manifests. A file whose time and size stay is not read again; one that was
written anew with the same content makes no batch. Batches are dealt over tasks, which read the contents.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, state string, sha256 string, content binary"
EMPTY = "empty"


def read_manifest(state: str, name: str) -> dict[str, list]:
    """path: [time, size, sha256]."""
    if name == EMPTY:
        return {}
    with open(f"{state}/{name}.json", encoding="utf-8") as f:
        return json.load(f)


def _digest(path: str) -> str:
    hashed = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            hashed.update(block)
    return hashed.hexdigest()


def take_manifest(root: str, suffix: str, before: dict[str, list]) -> dict[str, list]:
    """The folder as it is now; hashes of files that kept time and size are taken over."""
    out = {}
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if not d.startswith("."))
        for name in sorted(names):
            if not name.endswith(suffix):
                continue
            path = f"{folder}/{name}"
            try:
                stat = os.stat(path)
                known = before.get(path)
                same = known and known[:2] == [stat.st_mtime_ns, stat.st_size]
                out[path] = known if same else [stat.st_mtime_ns, stat.st_size, _digest(path)]
            except FileNotFoundError:  # gone between listing and reading: deleted
                continue
    return out


def content_name(manifest: dict[str, list]) -> str:
    """The name of a manifest depends on paths and contents alone, so touching a file makes no batch."""
    lines = "".join(f"{path}\0{entry[2]}\n" for path, entry in sorted(manifest.items()))
    return hashlib.sha256(lines.encode()).hexdigest() if manifest else EMPTY


def changes(before: dict[str, list], after: dict[str, list]) -> list[tuple[str, str, str | None]]:
    """(path, state, sha256) of what differs: added, changed or deleted."""
    out = [(p, "changed" if p in before else "added", e[2]) for p, e in after.items() if p not in before or before[p][2] != e[2]]
    return sorted(out + [(p, "deleted", None) for p in before if p not in after])


@dataclass
class _Part(InputPartition):
    files: list[tuple[str, str, str | None]]


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state = options["root"].rstrip("/"), options["state"].rstrip("/")
        self.suffix, self.each = options.get("suffix", ".java"), int(options.get("filesPerTask", 64))
        self.last: tuple[str, dict[str, list]] | None = None

    def _keep(self, manifest: dict[str, list]) -> str:
        name = content_name(manifest)
        path = f"{self.state}/{name}.json"
        if name != EMPTY and not os.path.exists(path):
            os.makedirs(self.state, exist_ok=True)
            with open(f"{path}.part", "w", encoding="utf-8") as f:
                json.dump(manifest, f)
            os.replace(f"{path}.part", path)
        return name

    def initialOffset(self) -> dict:
        return {"manifest": EMPTY}

    def latestOffset(self) -> dict:
        now = take_manifest(self.root, self.suffix, self.last[1] if self.last else {})
        self.last = (self._keep(now), now)
        return {"manifest": self.last[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = changes(read_manifest(self.state, start["manifest"]), read_manifest(self.state, end["manifest"]))
        return [_Part(found[i : i + self.each]) for i in range(0, len(found), self.each)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, state, sha256 in partition.files:
            try:
                content = None
                if state != "deleted":
                    with open(path, "rb") as f:
                        content = f.read()
                yield path, state, sha256, content
            except FileNotFoundError:  # deleted since; the next batch says so
                continue

    def commit(self, end: dict) -> None:
        """Manifests from before the committed one are needed no more; an hour is left to whatever else reads them."""
        keep = {f"{end['manifest']}.json", f"{self.last[0]}.json" if self.last else ""}
        for name in os.listdir(self.state) if os.path.isdir(self.state) else []:
            path = f"{self.state}/{name}"
            if name.endswith(".json") and name not in keep and os.path.getmtime(path) < time.time() - 3600:
                os.unlink(path)


class SourceChanges(DataSource):
    """``spark.readStream.format("source_changes")`` with root, state and, if wanted, suffix and filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "source_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def source_changes(spark: SparkSession, root: str, state: str, suffix: str = ".java") -> DataFrame:
    """(path, state, sha256, content) stream of the changes of a folder that driver and executors see."""
    spark.dataSource.register(SourceChanges)
    return spark.readStream.format("source_changes").option("root", root).option("state", state).option("suffix", suffix).load()


def watch(spark: SparkSession, root: str, rebuild: Callable[[DataFrame], None], checkpoint: str, seconds: int = 3, once: bool = False, suffix: str = ".java") -> StreamingQuery:
    """Call ``rebuild`` with the changes (path, state, sha256, content), at most every ``seconds``; with ``once`` only with those that are there."""
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    stream = source_changes(spark, root, f"{checkpoint.removeprefix('file://')}/manifests", suffix)
    return stream.writeStream.foreachBatch(lambda rows, n: rebuild(rows)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
