"""The life of a baseline: which findings it knows, which are new, what of it is stale, and its next form.

A baseline holds entries (version 2: path, rule, match and context) or fingerprints (version 1), both of paths relative to a workspace. A
comparison is one table of entries with their state: active (found and known), new (found), stale (an entry that is no longer found) and
stale_legacy (a fingerprint that no finding has). Every form of maintenance and every count is a filter or a count of that table.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.plans import policy
from inkgauge.sources import reports

STATES = ("active", "new", "stale", "stale_legacy")
#: States that stay, by action and version.
KEEP = {
    "create": {1: ("active", "new"), 2: ("active", "new")},
    "update": {1: ("active", "new"), 2: ("active", "new", "stale")},
    "prune": {1: ("active",), 2: ("active",)},
}


def git_root(folder: Path) -> Path | None:
    return next((p for p in (folder, *folder.parents) if (p / ".git").exists()), None)


def workspace(paths: list[str]) -> str:
    """The root that paths of a scan are named from: the one git root of all of them, else their longest common folder; independent of their order."""
    if not paths:
        return str(Path.cwd().resolve())
    roots = [p.parent if p.is_file() else p for p in (Path(x).resolve() for x in paths)]
    tops = {git_root(r) for r in roots}
    if len(tops) == 1 and None not in tops:
        return str(tops.pop())
    return os.path.commonpath(roots)


def common_folder(documents: DataFrame) -> str | None:
    """The longest folder that all paths of a table share, None of an empty table: the common beginning of the first and the last path in component order."""
    parts = F.split("path", "/")
    ends = documents.where("path is not null").select(F.slice(parts, 1, F.size(parts) - 1).alias("f")).agg(F.min("f").alias("a"), F.max("f").alias("b")).first()
    if ends.a is None:
        return None
    same = [x for x, _ in iter_equal(ends.a, ends.b)]
    return "/".join(same) or ("/" if ends.a[:1] == [""] else "")


def iter_equal(a: list[str], b: list[str]):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x, y


def compare(found: DataFrame, documents: DataFrame, known: DataFrame, root: str | None = None) -> DataFrame:
    """path, rule_id, match, context_hash, fingerprint and state of findings of documents against a baseline (entries, or fingerprints of version 1).

    With a root, findings are named relative to it. A stale fingerprint has no entry, an entry of version 2 no fingerprint.
    """
    told = policy.identities(found, documents)
    if "fingerprint" in known.columns:
        if root:
            told, documents = policy.relative(told, root), policy.relative(documents, root)
        state, stale = policy.partition_legacy(policy.legacy_identities(told, documents), known)
        return state.withColumn("fingerprint", F.lit(None).cast("string")).unionByName(stale.withColumn("state", F.lit("stale_legacy")), allowMissingColumns=True)
    return policy.partition(policy.relative(told, root) if root else told, known).withColumn("fingerprint", F.lit(None).cast("string"))


def kept(state: DataFrame, action: str, version: int = 2) -> DataFrame:
    """The entries that an action on a baseline of a version leaves."""
    return state.where(F.col("state").isin(*KEEP[action][version])).select(*policy.KEY)


def summaries(state: DataFrame, version: int = 2) -> DataFrame:
    """A row for each action: format (the baseline's version before), active, stale, new, entries (after the action) and action; one aggregate for all of them."""
    counted = state.agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))
    total = lambda states: sum((F.col(s) for s in states), F.lit(0).cast("long"))
    after = {action: total(states[version]) for action, states in KEEP.items()} | {"summary": total(("active", "stale", "stale_legacy"))}
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("action"), n.alias("entries")) for a, n in after.items())))
    return counted.select(F.lit(version).cast("long").alias("format"), "active", (F.col("stale") + F.col("stale_legacy")).alias("stale"), "new", rows.alias("x")).select("format", "active", "stale", "new", "x.entries", "x.action")


def maintain(spark: SparkSession, found: DataFrame, documents: DataFrame, path: str, action: str, root: str | None = None) -> dict[str, int]:
    """Create, update or prune a baseline file, replaced as a whole, or only summarize it ("summary"); its counts. All but create need the file."""
    if action not in (*KEEP, "summary"):
        raise ValueError(f"unknown action {action!r}")
    if action == "create":
        known, version = spark.createDataFrame([], "path string, rule_id string, match string, context_hash string"), 2
    else:
        known = reports.load_baseline(spark, path)
        version = 1 if "fingerprint" in known.columns else 2
    state = compare(found, documents, known, root)
    counts = summaries(state, version).where(F.col("action") == action).drop("action").first().asDict()
    if action != "summary":
        reports.save_baseline(kept(state, action, version), path)
    return counts
