"""Files as documents: discovery, and reading by the executors with a row for each file that can't be read."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions.ship import ship

INCLUDE = ("*.md", "*.mdx", "*.markdown", "*.py")


def excluded(path: Path, roots: list[Path], patterns: list[str]) -> bool:
    """Whether a pattern matches a path relative to a root, or anywhere unless it begins with a slash. A slash at the end means all below."""
    for pattern in patterns:
        anchored = pattern.startswith("/")
        glob = (pattern.lstrip("/") + "**" if pattern.endswith("/") else pattern.lstrip("/")).replace("//", "/")
        names = [PurePosixPath(path.relative_to(r).as_posix()) for r in roots if path.is_relative_to(r)]
        if not anchored:
            names.append(PurePosixPath(path.as_posix()))
        for name in names:
            if name.full_match(glob) or not anchored and name.full_match(f"**/{glob}"):
                return True
    return False


def git_ignored(root: Path, paths: list[Path]) -> set[Path]:
    """The paths that git ignores under root; none where git is missing."""
    if not paths:
        return set()
    try:
        told = subprocess.run(["git", "-C", str(root), "check-ignore", "--stdin", "-z", "--no-index"], input="\0".join(map(str, paths)).encode(), capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return set()
    return {Path(os.fsdecode(p)) for p in told.stdout.split(b"\0") if p}


def discover(paths: list[str], include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = (), use_git: bool = True) -> list[str]:
    """Explicit files, and files below folders that include names and git's ignore rules leave; all but those that exclude drops; each once, in order."""
    found: dict[str, None] = {}
    roots = [Path(p).resolve() for p in paths if Path(p).is_dir()]
    for given in map(Path, paths):
        if given.is_file():
            if not excluded(given.resolve(), [*roots, given.resolve().parent], list(exclude)):
                found[str(given)] = None
            continue
        if not given.is_dir():
            raise FileNotFoundError(str(given))
        below = sorted({f for pattern in include for f in given.rglob(pattern) if f.is_file() and not excluded(f.resolve(), roots, list(exclude))})
        ignored = git_ignored(given, below) if use_git else set()
        found.update((str(f), None) for f in below if f not in ignored)
    return list(found)


DOCUMENT = "path string, content string, read_error string"
#: Paths of a read's task at least, and bytes of text of a batch.
PATHS_A_TASK, BATCH = 64, 8 << 20


def text_of(path: str) -> tuple[str | None, str | None]:
    """A file's text, of strict UTF-8 with line ends as line feeds, or why it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read(), None
    except (OSError, UnicodeDecodeError) as problem:
        return None, f"{type(problem).__name__}: {problem}"


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows.append((path, *text_of(path)))
            held += len(rows[-1][1] or "")
            if held > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "content", "read_error"])
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "content", "read_error"])


def read_table(paths: DataFrame) -> DataFrame:
    """Documents (path, content, read_error) of a table of paths, read where its rows are. A file that is gone, forbidden or no UTF-8 has a read_error instead of a content and harms no other."""
    ship(paths.sparkSession)
    return paths.select("path").where("path is not null").mapInArrow(_contents, DOCUMENT)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents (path, content, read_error) of a list of files."""
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return read_table(listed.repartition(max(1, min(len(paths) // PATHS_A_TASK + 1, 10_000))))


def readable(documents: DataFrame) -> DataFrame:
    """Documents (path, content) without those that couldn't be read."""
    return documents.where("read_error is null").select("path", "content")


def unreadable(documents: DataFrame) -> DataFrame:
    """path, read_error of the files that couldn't be read."""
    return documents.where("read_error is not null").select("path", "read_error")


def from_table(df: DataFrame, key: str, text: str, suffix: str = ".md") -> DataFrame:
    """Documents of any table with a key and a text column."""
    return df.select(F.concat(F.lit(f"{key}_"), F.col(f"`{key}`").cast("string"), F.lit(suffix)).alias("path"), F.col(f"`{text}`").cast("string").alias("content"))


def in_memory(spark: SparkSession, content: str, path: str) -> DataFrame:
    """One document under a virtual path."""
    return spark.createDataFrame([(path, content)], "path string, content string")
