"""The command line: python -m inkgauge check | baseline | watch | rules | explain | init | docs | version.

Exit codes: 0 nothing to report, 1 an error or a warning survives (or explain knows no such rule), 2 wrong use or configuration, 3 a file
can't be read. Wrong use is told before a session starts. What is given here comes before the configuration: a profile replaces its selection and
limits, a selection takes back the ignores that it overlaps, ignores are added.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from inkgauge.plans import baseline, catalog, engine, policy
from inkgauge.plans.policy import Policy
from inkgauge.sources import config, discovery, files, reports

#: What init writes.
DEFAULT = """\
# include = ["*.md", "*.mdx", "*.markdown", "*.py"]
# exclude = ["venv/**", ".venv/**", "node_modules/**", ".git/**"]
# profile = "technical-docs"
# select = ["V", "S", "T", "G", "C", "M"]
# ignore = ["T003"]
minimum_severity = "warning"  # error, warning, info

# [severity]
# V001 = "error"

# [vocabulary]
# additional = ["gamified"]
# allowed = ["crucial"]

# [[per-file-ignores]]
# pattern = "tests/*"
# ignore = ["V001", "V002"]
"""


class Misuse(Exception):
    """Wrong arguments or configuration: exit code 2."""


def _rules(text: str | None) -> set[str]:
    return {t.strip().upper() for t in (text or "").split(",") if t.strip()}


def overlaps(ignored: str, selected: set[str]) -> bool:
    """Whether a selection takes an ignore back: the same rule or category, or one inside the other."""
    return any(ignored == s or s[:1] == ignored or ignored[:1] == s for s in selected)


def effective(args: argparse.Namespace, conf: config.Config) -> Policy:
    """The configuration's policy under what the command line says."""
    own, changes = conf.policy, {}
    if args.profile:
        preset = Policy.of_profile(args.profile)
        changes = {"select": preset.select, "minimum_severity": preset.minimum_severity, "min_confidence": preset.min_confidence}
    ignore = set(own.ignore)
    if args.select:
        changes["select"] = _rules(args.select)
        ignore = {i for i in ignore if not overlaps(i, changes["select"])}
    changes["ignore"] = ignore | _rules(args.ignore)
    if args.severity:
        changes["minimum_severity"] = args.severity
    sure = args.min_confidence or ("medium" if args.hide_low else None)
    if sure:
        changes["min_confidence"] = sure
    return dataclasses.replace(own, **changes)


def prepared(args: argparse.Namespace) -> tuple[config.Config, Policy]:
    try:
        conf = config.load(args.config)
        return conf, effective(args, conf)
    except (ValueError, OSError) as problem:
        raise Misuse(f"Configuration error: {problem}") from problem


def existing(paths: list[str]) -> list[str]:
    missing = [p for p in paths if not Path(p).exists()]
    if missing:
        raise Misuse("\n".join(f"Path does not exist: {p}" for p in missing))
    return paths


def shown(conf: config.Config, own: Policy, form: str) -> str:
    told = {
        "Config file": conf.path or "default", "Select": sorted(own.select) if own.select is not None else None, "Ignore": sorted(own.ignore), "Include patterns": list(conf.include), "Exclude patterns": list(conf.exclude),
        "Minimum severity": own.minimum_severity, "Minimum confidence": own.min_confidence, "Severity overrides": own.severity, "Per-file ignores": {k: sorted(v) for k, v in own.per_file_ignores.items()}, "Output format": form,
    }
    return "\n".join(["Configuration:", *(f"  {name}: {value}" for name, value in told.items() if value != {})])


def documents(spark: SparkSession, paths: list[str], conf: config.Config) -> DataFrame:
    return files.read_table(discovery.discover(spark, paths, conf.include, conf.exclude))


def rendered(found: DataFrame, form: str, checked: int, quiet: bool) -> str:
    if form == "json":
        return reports.as_json(found, checked)
    if form == "sarif":
        return reports.as_sarif(found)
    return "\n".join(reports.as_text(found, quiet) if form == "text" else (r.value for r in reports.jsonl(found).toLocalIterator()))


def check(args: argparse.Namespace, session: Callable[[], SparkSession], out: Callable[[str], None], stdin: Callable[[], str]) -> int:
    piped = "-" in args.paths
    if piped and args.paths != ["-"]:
        raise Misuse("Standard input '-' cannot be combined with file paths")
    if piped != (args.filename is not None):
        raise Misuse("--filename is needed with standard input '-', and only there")
    if piped and args.baseline:
        raise Misuse("Baselines are not supported with standard input")
    paths = [] if piped else existing(args.paths)
    conf, own = prepared(args)
    if args.baseline and not Path(args.baseline).exists():
        raise Misuse(f"Configuration error: {args.baseline}: baseline file not found")
    if args.show_config:
        out(shown(conf, own, args.format))
        return 0
    spark = session()
    docs = files.in_memory(spark, stdin().replace("\r\n", "\n").replace("\r", "\n"), args.filename) if piped else documents(spark, paths, conf)
    bad = None if piped else files.unreadable(docs)
    good = docs if piped else files.readable(docs)
    found = engine.check(good, own)
    if args.baseline:
        found = policy.without_known(found, good, reports.load_baseline(spark, args.baseline), baseline.workspace(paths))
    if not any(Path(p).is_absolute() for p in paths):  # names as they were given
        found = policy.relative(found, str(Path.cwd()))
    checked = good.count()
    if args.output:
        reports.write(found, args.output, args.format, args.quiet, checked)
    else:
        out(rendered(found, args.format, checked, args.quiet))
    for r in bad.toLocalIterator() if bad is not None else ():
        print(f"Could not read file: {r.path}: {r.read_error}", file=sys.stderr)
    return reports.exit_code(found, bad)


def maintain(args: argparse.Namespace, session: Callable[[], SparkSession], out: Callable[[str], None]) -> int:
    paths = existing(args.paths)
    conf, own = prepared(args)
    if args.action != "create" and not Path(args.baseline).exists():
        raise Misuse(f"Configuration error: {args.baseline}: baseline file not found")
    spark = session()
    docs = documents(spark, paths, conf)
    bad = files.unreadable(docs).first()
    if bad is not None:
        print(f"Could not read file: {bad.path}: {bad.read_error}", file=sys.stderr)
        return 3
    good = files.readable(docs)
    try:
        counts = baseline.maintain(spark, engine.check(good, own), good, args.baseline, args.action, baseline.workspace(paths))
    except ValueError as problem:
        raise Misuse(f"Configuration error: {problem}") from problem
    out("\n".join([f"Baseline {args.action}: {args.baseline}", *(f"  {name.capitalize()}: {counts[name]}" for name in ("format", "active", "stale", "new", "entries"))]))
    return 0


def follow(args: argparse.Namespace, session: Callable[[], SparkSession], out: Callable[[str], None]) -> int:
    from inkgauge.streaming import watch

    paths = existing(args.paths)
    conf, own = prepared(args)
    spark = session()
    known = reports.load_baseline(spark, args.baseline) if args.baseline else None
    unread = lambda rows, _: [print(f"Could not read file: {r.path}: {r.read_error}", file=sys.stderr) for r in rows.toLocalIterator()]
    query = watch.watch(
        spark, [str(Path(p).absolute()) for p in paths], lambda found, _: out(rendered(found, "text", 0, args.quiet)), args.state, own, f"{args.interval} seconds", args.once, conf.include, conf.exclude,
        baseline=known, workspace=baseline.workspace(paths) if known is not None else None, on_unreadable=unread,
    )
    query.awaitTermination()
    return 0


# --- the catalog


def facts(r: catalog.Rule) -> dict[str, object]:
    return {"id": r.id, "name": r.name, "description": r.description, "category": r.category, "severity": r.severity, "confidence": r.confidence, "applies_to": list(r.applies_to), "content_scope": r.content_scope, "profiles": list(r.profiles), "config_key": r.config_key}


def category_table() -> str:
    counts = Counter(r.category for r in catalog.RULES.values())
    rows = [f"| `{letter}` | {name} | {counts[name]} |" for letter, name in sorted(catalog.CATEGORIES.items())]
    return "\n".join(["| Prefix | Category | Rules |", "|-|-|-|", *rows, f"| **Total** | | **{len(catalog.RULES)}** |"])


def rule_table() -> str:
    rows = [f"| `{r.id}` | {r.name} | {r.category} | {r.severity} | {r.confidence} | {', '.join(r.applies_to)} / {r.content_scope} | {r.config_key or '-'} |" for r in catalog.RULES.values()]
    return "\n".join(["| ID | Name | Category | Severity | Confidence | Context | Configuration |", "|-|-|-|-|-|-|-|", *rows])


TABLES = {"categories": category_table, "rules": rule_table}


def with_tables(text: str) -> str:
    """text with the catalog's tables between its marks <!-- inkgauge:NAME:start --> and <!-- inkgauge:NAME:end -->, each pair once and in order."""
    for name, made in TABLES.items():
        start, end = (f"<!-- inkgauge:{name}:{edge} -->" for edge in ("start", "end"))
        if start not in text and end not in text:
            continue
        if text.count(start) != 1 or text.count(end) != 1 or text.index(start) > text.index(end):
            raise Misuse(f"the marks of {name!r} must stand once each, in order")
        text = f"{text[: text.index(start)]}{start}\n\n{made()}\n\n{text[text.index(end):]}"
    return text


def docs(args: argparse.Namespace, out: Callable[[str], None]) -> int:
    stale = []
    for path in map(Path, existing(args.paths)):
        text = path.read_text(encoding="utf-8")
        fresh = with_tables(text)
        if fresh != text:
            stale.append(str(path))
            if args.write:
                path.write_text(fresh, encoding="utf-8", newline="\n")
    for path in stale:
        out(f"{'Updated' if args.write else 'Stale'}: {path}")
    return 1 if stale and not args.write else 0


def catalog_command(args: argparse.Namespace, out: Callable[[str], None]) -> int:
    if args.command == "rules":
        told = [facts(r) for r in catalog.RULES.values()]
        out(json.dumps(told, indent=2) if args.format == "json" else "\n".join(f"{r['id']}  {r['severity']:8}{r['confidence']:8}{r['category']:12}{r['name']}" for r in told))
        return 0
    if args.command == "explain":
        r = catalog.explain(args.rule_id)
        if r is None:
            print(f"Unknown rule: {args.rule_id}", file=sys.stderr)
            return 1
        out(json.dumps(facts(r), indent=2) if args.format == "json" else "\n".join(f"{name}: {', '.join(v) if isinstance(v, list) else v if v is not None else '-'}" for name, v in facts(r).items()))
        return 0
    if args.command == "init":
        at = Path(f".{config.NAME}.toml")
        if at.exists():
            raise Misuse(f"Config file already exists: {at}")
        at.write_text(DEFAULT, encoding="utf-8")
        out(f"Created {at}")
        return 0
    out(f"inkgauge {reports.VERSION}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("inkgauge")
    commands = top.add_subparsers(dest="command", required=True)

    def scanning(name: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        if name == "baseline":
            made.add_argument("action", choices=(*baseline.KEEP, "summary"))
        made.add_argument("paths", nargs="+")
        for names, more in (
            (("--select", "-s"), {}), (("--ignore", "-i"), {}), (("--config", "-c"), {}), (("--profile",), {"choices": tuple(catalog.PROFILES)}), (("--severity",), {"choices": ("error", "warning", "info")}),
            (("--min-confidence",), {"choices": tuple(catalog.CONFIDENCES)}), (("--hide-low",), {"action": "store_true"}), (("--quiet", "-q"), {"action": "store_true"}),
        ):
            made.add_argument(*names, **more)
        made.add_argument("--baseline", "-b", default=f".{config.NAME}-baseline.json" if name == "baseline" else None)
        return made

    one = scanning("check")
    one.add_argument("--filename")
    one.add_argument("--format", "-f", choices=tuple(reports.FORMATS), default="text")
    one.add_argument("--output", "-o", help="a report file, written by the tasks")
    one.add_argument("--show-config", action="store_true")
    scanning("baseline")
    three = scanning("watch")
    three.add_argument("--interval", "-n", type=float, default=2.0)
    three.add_argument("--state", default=f".{config.NAME}-watch", help="the folder of what was seen")
    three.add_argument("--once", action="store_true")
    for name in ("rules", "explain"):
        told = commands.add_parser(name)
        told.add_argument("--format", "-f", choices=("text", "json"), default="text")
        if name == "explain":
            told.add_argument("rule_id")
    written = commands.add_parser("docs")
    written.add_argument("paths", nargs="+")
    written.add_argument("--write", action="store_true")
    commands.add_parser("init")
    commands.add_parser("version")
    return top


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("inkgauge").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None, session: Callable[[], SparkSession] = _session, out: Callable[[str], None] = print, stdin: Callable[[], str] = sys.stdin.read) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "check":
            return check(args, session, out, stdin)
        if args.command == "baseline":
            return maintain(args, session, out)
        if args.command == "watch":
            return follow(args, session, out)
        return docs(args, out) if args.command == "docs" else catalog_command(args, out)
    except Misuse as problem:
        print(problem, file=sys.stderr)
        return 2
