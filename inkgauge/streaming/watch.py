"""Watching files: a streaming source that gives a file again whenever it was modified, and a query that checks each batch.

Spark's own file source reads a path once and never again, so it can't watch. Here an offset is the number of a version. What a version
changed (path and modification time, null for a file that is gone) is a small file of its own beside the query's checkpoint; all versions
together are the state, a time for each path. A batch is the paths that changed between two versions: the driver knows their names and
no more, the executors read the files. Versions that no batch can ask for again are folded into one, so the state stays as large as the listing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from inkgauge.functions.ship import ship
from inkgauge.plans import engine
from inkgauge.plans import policy as policies
from inkgauge.plans.policy import Policy
from inkgauge.sources.files import INCLUDE, discover, text_of

#: Paths of a partition; versions that are kept apart before they are folded.
PATHS_A_PARTITION, APART = 64, 32
SCHEMA = "path string, mtime double, content string, read_error string"


class Versions:
    """A log of changes in a folder: version n is the file n.json, a map of paths to times; base-n.json is all up to n."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _numbers(self) -> tuple[int, list[int]]:
        names = [x for x in os.listdir(self.folder) if x.endswith(".json")]
        base = max((int(x[5:-5]) for x in names if x.startswith("base-")), default=0)
        return base, sorted(n for x in names if not x.startswith("base-") and (n := int(x[:-5])) > base)

    def _load(self, name: str) -> dict[str, float | None]:
        with open(os.path.join(self.folder, name), encoding="utf-8") as f:
            return json.load(f)

    def _store(self, name: str, changes: dict[str, float | None]) -> None:
        at = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(at, "w", encoding="utf-8") as f:
            json.dump(changes, f)
        os.replace(at, os.path.join(self.folder, name))

    def latest(self) -> int:
        base, numbers = self._numbers()
        return numbers[-1] if numbers else base

    def changes(self, start: int, end: int) -> dict[str, float | None]:
        """The last change of each path after version start, up to end. Folded versions come whole."""
        base, numbers = self._numbers()
        found: dict[str, float | None] = {}
        if base and start < base <= end:
            found |= self._load(f"base-{base}.json")
        for n in numbers:
            if start < n <= end:
                found |= self._load(f"{n}.json")
        return found

    def state(self) -> dict[str, float]:
        return {p: at for p, at in self.changes(-1, self.latest()).items() if at is not None}

    def add(self, changes: dict[str, float | None]) -> int:
        number = self.latest() + 1
        self._store(f"{number}.json", changes)
        return number

    def fold(self, upto: int) -> None:
        """Make one of all versions up to a number, if there are many."""
        base, numbers = self._numbers()
        old = [n for n in numbers if n <= upto]
        if len(old) < APART:
            return
        whole = {p: at for p, at in self.changes(-1, upto).items() if at is not None}
        self._store(f"base-{upto}.json", whole)
        for name in [f"{n}.json" for n in old] + ([f"base-{base}.json"] if base else []):
            os.remove(os.path.join(self.folder, name))


class Paths(InputPartition):
    def __init__(self, listed: list[tuple[str, float]]) -> None:
        super().__init__(listed)
        self.listed = listed


class ChangedFiles(DataSource):
    """path, mtime, content, read_error of modified files; options: paths, include and exclude (JSON lists), git, and state, the folder of the versions."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return Changes(self.options)


class Changes(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.include, self.exclude = (tuple(json.loads(options.get(k, d))) for k, d in (("paths", "[]"), ("include", json.dumps(INCLUDE)), ("exclude", "[]")))
        self.git = options.get("git", "true") == "true"
        self.versions = Versions(options["state"])
        self.known: dict[str, float] | None = None
        self.done = 0

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": None}  # the tasks need no listing

    def initialOffset(self) -> dict:
        return {"version": 0}

    def listed(self) -> dict[str, float]:
        found = {}
        for path in discover([p for p in self.paths if os.path.exists(p)], self.include, self.exclude, self.git):
            try:
                found[path] = os.stat(path).st_mtime
            except OSError:  # gone meanwhile
                continue
        return found

    def latestOffset(self) -> dict:
        if self.known is None:
            self.known = self.versions.state()
        now = self.listed()
        changes: dict[str, float | None] = {p: at for p, at in now.items() if self.known.get(p) != at}
        changes |= {p: None for p in self.known.keys() - now.keys()}
        self.known = now
        return {"version": self.versions.add(changes) if changes else self.versions.latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        changed = sorted((p, at) for p, at in self.versions.changes(start["version"], end["version"]).items() if at is not None)
        return [Paths(changed[k : k + PATHS_A_PARTITION]) for k in range(0, len(changed), PATHS_A_PARTITION)]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path, at in partition.listed:
            yield path, at, *text_of(path)

    def commit(self, end: dict) -> None:
        before, self.done = self.done, end["version"]  # a restart may ask for the last batch again, for none before it
        self.versions.fold(before)


def watch(
    spark: SparkSession, paths: list[str], on_findings: Callable[[DataFrame, int], None], checkpoint: str, policy: Policy | None = None, interval: str = "2 seconds", once: bool = False,
    include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = (), use_git: bool = True, baseline: DataFrame | None = None, workspace: str | None = None, on_unreadable: Callable[[DataFrame, int], None] | None = None,
):
    """A streaming query that checks whole changed files and hands each batch's findings to on_findings, and files that can't be read to on_unreadable.

    The policy and the baseline are those given at the start. With a baseline, findings that it knows are left out; its paths are relative to workspace.
    """
    ship(spark)
    spark.dataSource.register(ChangedFiles)
    checkpoint = checkpoint if "://" in checkpoint else os.path.abspath(checkpoint)
    state = os.path.join(checkpoint.removeprefix("file://"), "watched")
    options = {"paths": json.dumps(list(paths)), "include": json.dumps(list(include)), "exclude": json.dumps(list(exclude)), "git": str(use_git).lower(), "state": state}
    stream = spark.readStream.format("changed_files").options(**options).load()

    def run(batch: DataFrame, number: int) -> None:
        docs = batch.where("read_error is null").select("path", "content")
        found = engine.check(docs, policy)
        if baseline is not None:
            found = policies.without_known(found, docs, baseline, workspace)
        on_findings(found, number)
        if on_unreadable is not None:
            on_unreadable(batch.where("read_error is not null").select("path", "read_error"), number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
