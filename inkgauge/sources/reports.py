"""Findings as text, JSON, JSON Lines and SARIF, and baseline files.

A report is pieces of text around findings in order. as_text(), as_json() and as_sarif() join them on the driver, for people; write()
leaves any number of findings in one file: each task writes the pieces of its own run of findings, and one commit joins the runs, as bytes.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from inkgauge.functions.ship import ship
from inkgauge.plans import catalog

VERSION, SCHEMA_VERSION = "0.1.0", 1
FIELDS = ["rule_id", "message", "line", "column", "end_line", "end_column", "severity", "confidence", "suggestion"]
_LEVEL = {"error": "error", "warning": "warning", "info": "note", "off": "none"}
_RANK = {"high": 90.0, "medium": 50.0, "low": 10.0}


def ordered(found: DataFrame) -> DataFrame:
    """By the path's components, then in each document's order."""
    return found.orderBy(F.split("path", "/"), "seq")


def summary(found: DataFrame) -> DataFrame:
    """One row: issues, files, and issues by severity and confidence. All that isn't an error or a warning counts as info."""
    count = lambda c: F.count_if(c)
    s, c = F.col("severity"), F.col("confidence")
    return found.agg(
        F.count("*").alias("issues"), F.countDistinct("path").alias("files"), count(s == "error").alias("errors"), count(s == "warning").alias("warnings"), count(~s.isin("error", "warning")).alias("info"),
        count(c == "high").alias("high"), count(c == "medium").alias("medium"), count(c == "low").alias("low"),
    )


def exit_code(found: DataFrame, unreadable: DataFrame | None = None) -> int:
    """3 if a file couldn't be read, 1 if an error or a warning survives, else 0."""
    if unreadable is not None and not unreadable.isEmpty():
        return 3
    return 0 if found.where(F.col("severity").isin("error", "warning")).isEmpty() else 1


def jsonl(found: DataFrame) -> DataFrame:
    """A JSON object for each finding, nulls kept."""
    row = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(VERSION).alias("version"), "path", *FIELDS)
    return ordered(found).select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(found: DataFrame, folder: str) -> None:
    jsonl(found).write.mode("overwrite").text(folder)


# --- reports as pieces


@dataclass
class Counts:
    """What the end of a report tells; those of runs are added up."""

    issues: int = 0
    files: int = 0
    errors: int = 0
    warnings: int = 0
    high: int = 0
    low: int = 0

    def add(self, r: Row) -> None:
        self.issues += 1
        self.errors += r.severity == "error"
        self.warnings += r.severity == "warning"
        self.high += r.confidence == "high"
        self.low += r.confidence == "low"

    @property
    def info(self) -> int:
        """All that isn't an error or a warning."""
        return self.issues - self.errors - self.warnings


def _dumped(value: object, depth: int) -> str:
    """JSON as it stands that deep in an indented document, without its first indent."""
    return json.dumps(value, indent=2).replace("\n", "\n" + " " * depth)


class Report:
    """One format: what stands around and between findings. Findings of a path are a group; quiet has errors alone and no summary."""

    by_components = True  # paths are in the order of their components, else of their characters
    between_groups = between = ""

    def __init__(self, files_checked: int | None = None, quiet: bool = False) -> None:
        self.files_checked, self.quiet = files_checked, quiet

    def shown(self, found: DataFrame) -> DataFrame:
        return found

    def head(self, any_: bool) -> str:
        return ""

    def group(self, path: str | None) -> str:
        return ""

    def end_group(self) -> str:
        return ""

    def finding(self, r: Row) -> str:
        raise NotImplementedError

    def tail(self, counts: Counts) -> str:
        return ""


class Text(Report):
    def shown(self, found: DataFrame) -> DataFrame:
        return found.where(F.col("severity") == "error") if self.quiet else found

    def finding(self, r: Row) -> str:
        sure = "" if r.confidence == "medium" else f" [{r.confidence}]"
        return f"{r.path or ''}:{r.line}:{r.column}: {r.rule_id}{sure} [{r.severity}] {r.message}\n"

    def tail(self, c: Counts) -> str:
        if self.quiet:
            return ""
        if not c.issues:
            return "No issues found!\n"
        told = f"\nFound {c.issues} issue(s) ({c.errors} error, {c.warnings} warning, {c.info} info) in {c.files} file(s)\n"
        return told + (f"Confidence: {c.high} high, {c.issues - c.high - c.low} medium, {c.low} low\n" if c.high or c.low else "")


class JsonLines(Report):
    def finding(self, r: Row) -> str:
        return json.dumps({"schema_version": SCHEMA_VERSION, "version": VERSION, "path": r.path} | {f: r[f] for f in FIELDS}) + "\n"


class Json(Report):
    between_groups = between = ",\n"

    def head(self, any_: bool) -> str:
        return f'{{\n  "schema_version": {SCHEMA_VERSION},\n  "version": {json.dumps(VERSION)},\n  "files": [' + ("\n" if any_ else "")

    def group(self, path: str | None) -> str:
        return f'    {{\n      "path": {json.dumps(path)},\n      "issues": [\n'

    def end_group(self) -> str:
        return "\n      ]\n    }"

    def finding(self, r: Row) -> str:
        return "        " + _dumped({f: r[f] for f in FIELDS}, 8)

    def tail(self, c: Counts) -> str:
        total = {"total_issues": c.issues, "files_checked": c.files if self.files_checked is None else self.files_checked, "errors": c.errors, "warnings": c.warnings, "info": c.info}
        return ("\n  " if c.issues else "") + f'],\n  "summary": {_dumped(total, 2)}\n}}'


class Sarif(Report):
    by_components = False
    between_groups = between = ",\n"

    def head(self, any_: bool) -> str:
        rules = [{"id": r.id, "name": r.name, "shortDescription": {"text": r.description}, "defaultConfiguration": {"level": _LEVEL[r.severity]}, "properties": {"category": r.category}} for r in catalog.RULES.values()]
        run = {"tool": {"driver": {"name": "inkgauge", "version": VERSION, "rules": rules}}, "results": []}
        whole = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)
        return whole[: whole.rindex("[]") + 1] + ("\n" if any_ else "")

    def finding(self, r: Row) -> str:
        region = {"startLine": r.line, "startColumn": r.column, "endLine": r.end_line or r.line, "endColumn": r.end_column or r.column}
        place = {"physicalLocation": {"artifactLocation": {"uri": r.path}, "region": region}}
        told = {"ruleId": r.rule_id, "level": _LEVEL.get(r.severity, "warning"), "message": {"text": r.message}, "locations": [place], "properties": {"confidence": r.confidence}, "rank": _RANK.get(r.confidence, 50.0)}
        return "        " + _dumped(told, 8)

    def tail(self, c: Counts) -> str:
        return ("\n      " if c.issues else "") + "]\n    }\n  ]\n}"


FORMATS: dict[str, type[Report]] = {"text": Text, "jsonl": JsonLines, "json": Json, "sarif": Sarif}


@dataclass
class Run(WriterCommitMessage):
    """A task's findings in a file: its first and last path, what they count, and its place among the runs. The file lacks its first group's start and its last one's end."""

    file: str
    first: str | None
    last: str | None
    order: tuple
    counts: Counts = field(default_factory=Counts)


def _pieces(form: Report, rows: Iterable[Row], run: Run) -> Iterator[str]:
    """The text of a run, which also gets its paths and counts."""
    for r in rows:
        if not run.counts.issues:
            run.first, run.order = r.path, _order(form, r)
            run.counts.files = 1
        elif r.path != run.last:
            run.counts.files += 1
            yield form.end_group() + form.between_groups + form.group(r.path)
        else:
            yield form.between
        run.last = r.path
        run.counts.add(r)
        yield form.finding(r)


def _order(form: Report, r: Row) -> tuple:
    path = r.path.split("/") if form.by_components and r.path is not None else r.path or ""
    return r.path is not None, path, r.seq


def _in_order(form: Report, found: DataFrame) -> DataFrame:
    return form.shown(found).orderBy(F.split("path", "/") if form.by_components else "path", "seq").select("path", "seq", *FIELDS)


def _joined(form: Report, runs: list[Run]) -> Iterator[str | Run]:
    """A whole report of runs: pieces of text, and runs where their own text belongs."""
    total, before = Counts(), None
    yield form.head(bool(runs))
    for run in runs:
        if before is None:
            yield form.group(run.first)
        elif before.last == run.first:
            total.files -= 1
            yield form.between
        else:
            yield form.end_group() + form.between_groups + form.group(run.first)
        yield run
        for name in ("issues", "files", "errors", "warnings", "high", "low"):
            setattr(total, name, getattr(total, name) + getattr(run.counts, name))
        before = run
    if runs:
        yield form.end_group()
    yield form.tail(total)


def _small(form: Report, found: DataFrame) -> str:
    run = Run("", None, None, ())
    own = "".join(_pieces(form, _in_order(form, found).toLocalIterator(), run))
    return "".join(own if isinstance(x, Run) else x for x in _joined(form, [run] if run.counts.issues else []))


def as_text(found: DataFrame, quiet: bool = False) -> Iterator[str]:
    text = _small(Text(quiet=quiet), found)
    yield from text[:-1].split("\n") if text else ()


def as_json(found: DataFrame, files_checked: int | None = None) -> str:
    return _small(Json(files_checked), found)


def as_sarif(found: DataFrame) -> str:
    return _small(Sarif(), found)


class ReportFile(DataSource):
    """A sink of ordered findings; options path, form, quiet and files_checked. The path must be on a file system that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "findings_report"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(self.options)


class ReportWriter(DataSourceWriter):
    """Tasks write runs into a folder beside the report; the commit joins those of the tasks that counted, puts the report in its place at once and deletes the folder."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].removeprefix("file://")
        checked = options.get("files_checked", "")
        self.form = FORMATS[options.get("form", "json")](int(checked) if checked else None, options.get("quiet") == "true")
        self.folder = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Run:
        os.makedirs(self.folder, exist_ok=True)
        run = Run(os.path.join(self.folder, uuid.uuid4().hex), None, None, ())
        with open(run.file, "w", encoding="utf-8", newline="") as out:
            for piece in _pieces(self.form, iterator, run):
                out.write(piece)
        return run

    def commit(self, messages: list[Run | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        runs = sorted((m for m in messages if m is not None and m.counts.issues), key=lambda m: m.order)
        whole = os.path.join(self.folder, "whole")
        with open(whole, "wb") as out:
            for x in _joined(self.form, runs):
                if isinstance(x, Run):
                    with open(x.file, "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 20)
                else:
                    out.write(x.encode())
        os.replace(whole, self.path)
        shutil.rmtree(self.folder)

    def abort(self, messages: list[Run | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def write(found: DataFrame, path: str, form: str = "json", quiet: bool = False, files_checked: int | None = None) -> None:
    """Any number of findings as one report file of a format of FORMATS, the same to the byte as the small form's text (as_text's lines end with line feeds)."""
    spark = found.sparkSession
    ship(spark)
    spark.dataSource.register(ReportFile)
    path = path if "://" in path else os.path.abspath(path)  # tasks have folders of their own
    options = {"path": path, "form": form, "quiet": str(quiet).lower(), "files_checked": "" if files_checked is None else str(files_checked)}
    _in_order(FORMATS[form](quiet=quiet), found).write.format("findings_report").mode("append").options(**options).save()


def quality(expected: DataFrame, found: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """Per rule: tp, fp, fn, precision and recall of findings against expected ones (path, rule_id, line, column), and passed negative cases (path, rule_id, line)."""
    key = ["path", "rule_id", "line", "column"]
    e, g = expected.select(*key).distinct().withColumn("e", F.lit(1)), found.select(*key).distinct().withColumn("g", F.lit(1))
    m = e.join(g, key, "full_outer").groupBy("rule_id").agg(F.count_if(F.expr("e is not null and g is not null")).alias("tp"), F.count_if(F.expr("e is null")).alias("fp"), F.count_if(F.expr("g is null")).alias("fn"))
    m = m.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    if negatives is None:
        return m
    hit = found.select("path", "rule_id", "line").distinct().withColumn("hit", F.lit(True))
    n = negatives.select("path", "rule_id", "line").distinct().join(hit, ["path", "rule_id", "line"], "left").groupBy("rule_id").agg(F.count_if(F.expr("hit is null")).alias("negatives_passed"), F.count("*").alias("negatives_total"))
    return m.join(n, "rule_id", "full_outer")


def save_baseline(entries: DataFrame, path: str) -> None:
    """A sorted baseline file, written entry by entry and replaced as a whole."""
    fields = ["path", "rule_id", "match", "context_hash"]
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False, encoding="utf-8") as out:
        out.write('{\n  "version": 2,\n  "entries": [')
        between = "\n    "
        for r in entries.select(*fields).orderBy(*fields).toLocalIterator():
            out.write(between + json.dumps(r.asDict(), indent=2, ensure_ascii=False).replace("\n", "\n    "))
            between = ",\n    "
        out.write("]\n}\n" if between == "\n    " else "\n  ]\n}\n")
    os.replace(out.name, path)


def load_baseline(spark, path: str) -> DataFrame:
    """The entries of a baseline file of version 2, or the fingerprints of one of version 1 ("1.0")."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    version = data.get("version") if isinstance(data, dict) else None
    if version == "1.0" and set(data) == {"version", "fingerprints"} and all(isinstance(x, str) for x in data["fingerprints"]):
        return spark.createDataFrame([(x,) for x in sorted(set(data["fingerprints"]))], "fingerprint string")
    if version != 2 or set(data) != {"version", "entries"}:
        raise ValueError("invalid baseline")
    fields = ("path", "rule_id", "match", "context_hash")
    rows = [tuple(e[f] for f in fields) for e in data["entries"]]
    if len(set(rows)) != len(rows):
        raise ValueError("entries must not contain duplicates")
    return spark.createDataFrame(rows, "path string, rule_id string, match string, context_hash string")
