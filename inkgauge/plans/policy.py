"""What to run and what to keep: selection, severities, confidence, per-file ignores, suppressions and baselines."""

from __future__ import annotations

import difflib
import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.text import flat, has, squeeze
from inkgauge.plans import catalog
from inkgauge.plans import lexicon as L

#: The keyword of inline directives.
DIRECTIVE = "inkgauge"


@dataclass
class Policy:
    """Selected and ignored rules are ids or category letters; select of None is all. Severity overrides come before the least severity."""

    select: set[str] | None = None
    ignore: set[str] = field(default_factory=set)
    minimum_severity: str = "warning"
    min_confidence: str = "low"
    severity: dict[str, str] = field(default_factory=dict)
    per_file_ignores: dict[str, set[str]] = field(default_factory=dict)
    thresholds: dict[str, int] = field(default_factory=dict)
    allowed: tuple[str, ...] = ()
    additional: tuple[str, ...] = ()
    allowed_phrases: tuple[str, ...] = ("All notable changes", "Critical issue")
    #: Rules of one's own, which run beside the catalog's.
    own: tuple[catalog.UserRule, ...] = ()

    @classmethod
    def of_profile(cls, name: str, own: tuple[catalog.UserRule, ...] = ()) -> Policy:
        rules, severity, confidence = catalog.PROFILES[name]
        return cls(select=set(rules) | {u.rule.id for u in own if name in u.rule.profiles}, minimum_severity=severity, min_confidence=confidence, own=own)

    def __post_init__(self) -> None:
        if len({u.rule.id for u in self.own}) < len(self.own):
            raise ValueError("two rules of one's own share an id")
        known = {*self.known(), *catalog.CATEGORIES}
        named = [*(self.select or ()), *self.ignore, *self.severity, *(r for rules in self.per_file_ignores.values() for r in rules)]
        for name in named:
            if name not in known:
                near = difflib.get_close_matches(name, known, n=1)
                raise ValueError(f"unknown rule {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        for key, value in self.thresholds.items():
            if key not in {**catalog.THRESHOLDS, **{u.rule.id: 1 for u in self.own if u.threshold is not None}} or not isinstance(value, int) or isinstance(value, bool) or value < 1:
                raise ValueError(f"thresholds.{key} must be a known name and a positive integer")
        if self.minimum_severity not in catalog.SEVERITIES or self.min_confidence not in catalog.CONFIDENCES or not set(self.severity.values()) <= set(catalog.SEVERITIES):
            raise ValueError("unknown severity or confidence")

    def known(self) -> dict[str, catalog.Rule]:
        return catalog.RULES | {u.rule.id: u.rule for u in self.own}

    def severity_of(self, rule: str) -> str:
        return self.severity.get(rule, self.known()[rule].severity)

    def rules(self) -> set[str]:
        """The rules that run at all: their branches are never built otherwise."""
        inside = lambda names, r: r in names or r[0] in names
        least = catalog.SEVERITIES[self.minimum_severity]
        return {
            r
            for r in self.known()
            if (self.select is None or inside(self.select, r)) and not inside(self.ignore, r) and 0 < catalog.SEVERITIES[self.severity_of(r)] >= least
        }

    def limits(self) -> dict[str, int]:
        return {**catalog.THRESHOLDS, **{u.rule.id: u.threshold for u in self.own if u.threshold is not None}, **self.thresholds}


def finish(found: DataFrame, policy: Policy) -> DataFrame:
    """Severities, per-file ignores and the least confidence."""
    ids = sorted(policy.known())
    level = F.element_at(F.create_map(*(F.lit(v) for r in ids for v in (r, policy.severity_of(r)))), F.col("rule_id"))
    out = found.withColumn("severity", level)
    for pattern, rules in policy.per_file_ignores.items():
        regex = r"\A" + fnmatch.translate(pattern).replace(r"\Z", r"\z")
        # a null path has no name, so no pattern names it
        named = F.coalesce(has(F.col("path"), regex) | has(F.element_at(F.split("path", "/"), -1), regex), F.lit(False))
        out = out.where(~(named & (F.col("rule_id").isin(*rules) | F.substring("rule_id", 1, 1).isin(*rules))))
    keep = [c for c, rank in catalog.CONFIDENCES.items() if rank >= catalog.CONFIDENCES[policy.min_confidence]]
    return out if len(keep) == 3 else out.where(F.col("confidence").isin(*keep))


DIRECTIVES = "array<struct<line:int,token:string>>"


def suppressions(markdown: bool) -> Column:
    """line, token of a document's inline directives, over its columns lines (Markdown, where a directive speaks of the next line) or comments (Python, of their own line).

    A malformed directive fails the query.
    """
    token = r"\s*[A-Za-z][A-Za-z0-9]*\s*"
    good = rf"\A{token}(?:,{token})*\z"

    def named(at: Column, line: Column, tokens: Column) -> Column:
        problem = F.raise_error(F.concat(F.lit("line "), at.cast("string"), F.lit(": malformed inline suppression")))
        checked = F.when(has(tokens, good), tokens).otherwise(problem.cast("string"))
        return F.transform(F.split(checked, ","), lambda t: F.struct(line.alias("line"), F.upper(F.trim(t)).alias("token")))

    if markdown:
        regex = rf"(?iU)^\s*<!--\s*{DIRECTIVE}-ignore-next-line(?:\s+(.*?))?\s*-->\s*$"
        mark = lambda r: F.lower(F.trim(r["raw"]))
        wanted = F.filter("lines", lambda r: F.contains(r["raw"], F.lit("<!--")) & ~r["code"] & F.startswith(mark(r), F.lit("<!--")) & F.contains(mark(r), F.lit(f"{DIRECTIVE}-ignore-next-line")))
        return flat(F.transform(wanted, lambda r: named(r["n"], r["n"] + 1, F.regexp_extract(r["raw"], regex, 1))))
    regex = rf"(?iU)\s*{DIRECTIVE}:\s*ignore\s*=\s*(.*?)\s*$"
    wanted = F.filter("comments", lambda c: F.contains(F.lower(c["text"]), F.lit(f"{DIRECTIVE}:")))
    return flat(F.transform(wanted, lambda c: named(c["line"], c["line"], F.regexp_extract(c["text"], regex, 1))))


def suppressed(directives: Column, x: Column) -> Column:
    """Whether a directive names a finding, by rule or category letter, on its line."""
    return F.exists(directives, lambda d: (d["line"] == x["line"]) & ((d["token"] == x["rule_id"]) | (d["token"] == F.substring(x["rule_id"], 1, 1))))


# --- baselines


def identities(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with match and context_hash: what a finding is known by in a baseline, besides path and rule_id. Paths should be of one document each."""
    split = F.split("content", L.LINE_ENDS, -1)
    d = found.join(docs.select("path", "content").dropDuplicates(["path"]), "path").withColumn("own", F.coalesce(F.get(split, F.col("line") - 1), F.lit(""))).drop("content")
    n = F.length("own")
    start = F.least(F.greatest(F.col("column") - 1, F.lit(0)), n)
    spanned = F.col("end_column").isNotNull() & (F.col("end_column") - 1 > start) & (F.col("end_line").isNull() | (F.col("end_line") == F.col("line")))
    rest = F.substring("own", start + 1, n)
    token = F.regexp_extract(rest, r"(?U)^(?:\w+(?:[-'][\w]+)*|[^\w\s]+)", 0)
    raw = F.when(spanned, F.substring("own", start + 1, F.col("end_column") - 1 - start)).when(token != "", token).otherwise(F.substring(rest, 1, 80))
    end = start + F.length(raw)
    clean = lambda x: F.lower(squeeze(x))
    low = F.greatest(start - 32, F.lit(0))
    match = F.substring(clean(raw), 1, 80)
    context = F.substring("own", low + 1, F.least(n, end + 32) - low)
    return d.withColumns({"match": F.when(match == "", "<empty>").otherwise(match), "context_hash": F.substring(F.sha2(clean(context), 256), 1, 16)}).drop("own")


KEY = ["path", "rule_id", "match", "context_hash"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("path", F.upper("rule_id").alias("rule_id"), "match", "context_hash").distinct()


def partition(identified: DataFrame, baseline: DataFrame) -> DataFrame:
    """Entries of findings and baseline with their state: active (in both), new, or stale. Both are read once, by one grouping."""
    side = lambda df, now: df.select(*KEY, F.lit(now).alias("now"), F.lit(not now).alias("old"))
    both = side(_keyed(identified), True).unionByName(side(_keyed(baseline), False)).groupBy(*KEY).agg(F.max("now").alias("now"), F.max("old").alias("old"))
    return both.select(*KEY, F.when(F.col("now") & F.col("old"), "active").when(F.col("now"), "new").otherwise("stale").alias("state"))


def unknown(identified: DataFrame, baseline: DataFrame) -> DataFrame:
    """The findings that no baseline entry knows."""
    return identified.join(_keyed(baseline), KEY, "left_anti")


def without_known(found: DataFrame, docs: DataFrame, baseline: DataFrame, workspace: str | None = None) -> DataFrame:
    """The findings of documents that a baseline, of paths relative to a workspace, doesn't know; their own paths and columns stay."""
    identified = identities(found, docs).withColumn("own_path", F.col("path"))
    named = relative(identified, workspace) if workspace else identified
    left = unknown(named, baseline)
    return left.select(*(F.col("own_path").alias("path") if c == "path" else F.col(c) for c in found.columns))


def legacy_fingerprint(rule: Column, message: Column, path: Column, context: Column) -> Column:
    """The fingerprint of version 1: of rule, message and the three lines around."""
    short = lambda x: F.substring(F.sha2(x, 256), 1, 16)
    quoted = F.to_json(F.array(path)).substr(F.lit(2), F.length(F.to_json(F.array(path))) - 2)
    body = F.concat(F.lit('{"rule_id": "'), rule, F.lit('", "message_hash": "'), short(message), F.lit('", "relative_path": '), quoted, F.lit(', "context_hash": "'), short(context), F.lit('"}'))
    return F.substring(F.sha2(body, 256), 1, 32)


def legacy_identities(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with fingerprint: what a finding is known by in a baseline of version 1."""
    split = F.split("content", "\n", -1)
    low = F.greatest(F.col("line") - 1, F.lit(1))
    context = F.array_join(F.slice(split, low, F.col("line") + 2 - low), "\n")
    d = found.join(docs.select("path", "content").dropDuplicates(["path"]), "path").withColumn("own", F.coalesce(context, F.lit(""))).drop("content")
    return d.withColumn("fingerprint", legacy_fingerprint(F.col("rule_id"), F.col("message"), F.col("path"), F.col("own"))).drop("own")


def partition_legacy(identified: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of findings (with match, context_hash and fingerprint) as active or new against a baseline of version 1, and its stale fingerprints."""
    known = fingerprints.select("fingerprint").distinct().withColumn("known", F.lit(True))
    met = identified.join(known, "fingerprint", "left")
    state = met.groupBy("path", F.upper("rule_id").alias("rule_id"), "match", "context_hash").agg(F.when(F.max("known"), "active").otherwise("new").alias("state"))
    return state, known.join(identified.select("fingerprint").distinct(), "fingerprint", "left_anti").select("fingerprint")


def relative(found: DataFrame, workspace: str) -> DataFrame:
    """found with paths relative to a workspace, where they lie in it: what a baseline that travels should hold."""
    root = workspace.rstrip("/") + "/"
    return found.withColumn("path", F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path")))


def maintained(state: DataFrame, action: str) -> DataFrame:
    """The entries of a baseline after create (findings alone), update (all) or prune (without the stale ones)."""
    keep = {"create": ("active", "new"), "update": ("active", "new", "stale"), "prune": ("active",)}[action]
    return state.where(F.col("state").isin(*keep)).select(*KEY)


