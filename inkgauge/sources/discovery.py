"""Files of large trees as a table: folders are listed by the executors, level by level.

A round lists the folders of one level, each in its task; what it finds is written to the shared folder, and its folders are the next
round's. Rules of git's ignore files go down with the folders: each folder adds its own file's to those from above, the last rule that
matches decides, and an ignored folder is never listed. The driver knows the number of folders of a level, never their names.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions.ship import ship
from inkgauge.sources.files import INCLUDE, excluded

#: Folders of a task at most, and rows of a batch.
FOLDERS_A_TASK, BATCH = 32, 5_000
_RULE = pa.struct([("base", pa.string()), ("regex", pa.string()), ("negated", pa.bool_()), ("folders", pa.bool_())])
_FOUND = pa.schema([("folder", pa.bool_()), ("path", pa.string()), ("rules", pa.list_(_RULE))])
_KIND = "folder boolean, path string, rules array<struct<base:string,regex:string,negated:boolean,folders:boolean>>"


def glob_regex(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression over a path below the file's folder."""
    anchored, body = "/" in pattern.rstrip("/"), pattern.strip("/")
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i) and i + 2 == len(body) and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
            while body[i : i + 1] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out + r"\Z"


def rules_of(file: str, base: str) -> list[dict]:
    """The rules of an ignore file for what lies below base; none if it can't be read."""
    try:
        with open(file, encoding="utf-8", errors="surrogateescape") as f:
            lines = f.read().split("\n")
    except OSError:
        return []
    out = []
    for line in lines:
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        pattern = line[1:] if negated else line
        if pattern.strip("/"):
            out.append({"base": base, "regex": glob_regex(pattern), "negated": negated, "folders": pattern.endswith("/")})
    return out


def ignored(path: str, folder: bool, rules: list[dict]) -> bool:
    for r in reversed(rules):
        if (folder or not r["folders"]) and path.startswith(r["base"] + "/") and re.match(r["regex"], path[len(r["base"]) + 1 :], re.S):
            return not r["negated"]
    return False


def inherited(root: str) -> list[dict] | None:
    """The rules that a root has from its repository: the user's, the repository's own and those of the folders above; None outside any."""
    top = next((p for p in (Path(root), *Path(root).parents) if (p / ".git").exists()), None)
    if top is None:
        return None
    user = os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")
    rules = rules_of(user, str(top)) + rules_of(str(top / ".git" / "info" / "exclude"), str(top))
    between = [p for p in reversed(Path(root).parents) if p.is_relative_to(top)]
    return rules + [r for p in between for r in rules_of(str(p / ".gitignore"), str(p))]


def discover(spark: SparkSession, roots: list[str], include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = (), use_git: bool = True) -> DataFrame:
    """A table of the paths of files below folders, and of explicit files; each once. files.discover() is the same for small trees, as a list.

    Folders that are links aren't followed; a folder that can't be listed is passed over. Roots should be absolute and seen by all executors.
    """
    ship(spark)
    whole = [str(Path(r).absolute()) for r in roots]
    tops = [Path(r) for r in whole]

    def seeds() -> Iterator[dict]:
        for r in whole:
            if os.path.isdir(r):
                above = inherited(r) if use_git else None
                yield {"folder": True, "path": r, "rules": above if above is not None else [{"base": "", "regex": r"\Z.", "negated": False, "folders": False}]}
            elif os.path.isfile(r):
                if not excluded(Path(r), [*(t for t in tops if t.is_dir()), Path(r).parent], list(exclude)):
                    yield {"folder": False, "path": r, "rules": []}
            else:
                raise FileNotFoundError(r)

    def wanted(path: str) -> bool:
        below = next((PurePosixPath(path).relative_to(t) for t in tops if PurePosixPath(path).is_relative_to(t)), PurePosixPath(path))
        return any(below.full_match(f"**/{p}") for p in include) and not excluded(Path(path), tops, list(exclude))

    def listed(folder: str, rules: list[dict]) -> Iterator[dict]:
        outside = bool(rules) and rules[0]["base"] == ""  # no repository, so ignore files are plain files
        if not outside and use_git:
            rules = rules + rules_of(os.path.join(folder, ".gitignore"), folder)
        try:
            entries = list(os.scandir(folder))
        except OSError:
            return
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                inside = rules
                if use_git and outside and os.path.exists(os.path.join(e.path, ".git")):
                    inside = inherited(e.path)
                if e.name != ".git" and not (use_git and not outside and ignored(e.path, True, rules)):
                    yield {"folder": True, "path": e.path, "rules": inside}
            elif e.is_file() and wanted(e.path) and not (use_git and not outside and ignored(e.path, False, rules)):
                yield {"folder": False, "path": e.path, "rules": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for folder, rules in zip(batch.column("path").to_pylist(), batch.column("rules").to_pylist()):
                for row in listed(folder, rules):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _FOUND)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FOUND)

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="inkgauge-")
    at = f"{at.rstrip('/')}/discovery-{uuid.uuid4().hex}"
    spark.createDataFrame(list(seeds()), _KIND).write.parquet(f"{at}/level=0")
    level = 0
    while folders := (frontier := spark.read.schema(_KIND).parquet(f"{at}/level={level}").where("folder")).count():
        level += 1
        frontier.select("path", "rules").repartition(max(1, min(folders // FOLDERS_A_TASK + 1, 10_000))).mapInArrow(run, _KIND).write.parquet(f"{at}/level={level}")
    return spark.read.schema(_KIND).parquet(*(f"{at}/level={k}" for k in range(level + 1))).where("not folder").select("path").distinct()
