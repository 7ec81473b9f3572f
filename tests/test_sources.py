"""Discovery, reading, reports, scoring and the watch source."""

import json
import os

import pytest
from pyspark.sql import functions as F

from inkgauge.plans import baseline, engine, policy
from inkgauge.plans.policy import Policy
from inkgauge.sources import config, files, reports
from inkgauge.streaming import watch

FOUND = "path string, seq long, rule_id string, message string, line int, column int, end_line int, end_column int, severity string, confidence string, suggestion string"


def test_discovery_and_reading(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_bytes("one\r\ntwo\rthree".encode())
    (tmp_path / "a" / "skip.md").write_text("s")
    (tmp_path / "b.txt").write_text("t")
    got = files.discover([str(tmp_path)], exclude=("a/skip.md",), use_git=False)
    assert [os.path.basename(p) for p in got] == ["x.md"]
    assert [r.content for r in files.read(spark, got).collect()] == ["one\ntwo\nthree"]
    assert files.read(spark, []).count() == 0


def test_reports(spark):
    rows = [("a-b/x.md", 1, "V002", "m é", 2, 3, None, 5, "warning", "medium", None), ("a/x.md", 1, "T010", "n", 1, 1, 1, 3, "info", "high", "s")]
    found = spark.createDataFrame(rows, FOUND)
    assert list(reports.as_text(found)) == ["a/x.md:1:1: T010 [high] [info] n", "a-b/x.md:2:3: V002 [warning] m é", "", "Found 2 issue(s) (0 error, 1 warning, 1 info) in 2 file(s)", "Confidence: 1 high, 1 medium, 0 low"]
    assert json.loads(reports.as_json(found, 7))["summary"] == {"total_issues": 2, "files_checked": 7, "errors": 0, "warnings": 1, "info": 1}
    assert [json.loads(r.value)["end_line"] for r in reports.jsonl(found).collect()] == [1, None]
    sarif = json.loads(reports.as_sarif(found))["runs"][0]["results"]
    assert {r["level"] for r in sarif} == {"warning", "note"} and sarif[0]["locations"][0]["physicalLocation"]["region"]["endLine"] in (1, 2)
    assert reports.exit_code(found) == 1 and list(reports.as_text(found.where("false"))) == ["No issues found!"]


def test_quality_scores(spark):
    found = spark.createDataFrame([("a.md", 1, "V002", "m", 2, 3, None, 5, "warning", "medium", None)], FOUND)
    expected = spark.createDataFrame([("a.md", "V002", 2, 3), ("a.md", "V002", 9, 1)], "path string, rule_id string, line int, column int")
    r = reports.quality(expected, found).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 0, 1, 1.0, 0.5)


def test_baseline_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", "V001", "m", "0"), ("a", "V001", "m", "0")], "path string, rule_id string, match string, context_hash string")
    path = str(tmp_path / "base.json")
    reports.save_baseline(rows, path)
    assert [e["path"] for e in json.load(open(path))["entries"]] == ["a", "b"]
    assert reports.load_baseline(spark, path).count() == 2


def test_one_bad_file_harms_no_other(spark, tmp_path):
    (tmp_path / "good.md").write_text("Feel free to go.")
    (tmp_path / "bad.md").write_bytes(b"caf\xe9 \xff")
    (tmp_path / "empty.md").write_text("")
    paths = [str(tmp_path / n) for n in ("good.md", "bad.md", "empty.md", "gone.md")] + [str(tmp_path)]
    docs = files.read(spark, paths)
    assert {os.path.basename(r.path) for r in files.readable(docs).collect()} == {"good.md", "empty.md"}
    told = {os.path.basename(r.path): r.read_error.split(":")[0] for r in files.unreadable(docs).collect()}
    assert told == {"bad.md": "UnicodeDecodeError", "gone.md": "FileNotFoundError", tmp_path.name: "IsADirectoryError"}
    found = engine.check(files.readable(docs))
    assert [r.rule_id for r in found.collect()] == ["V002"]
    assert reports.exit_code(found, files.unreadable(docs)) == 3 and reports.exit_code(found, files.unreadable(files.read(spark, paths[:1]))) == 1


def test_explicit_files_can_be_excluded(tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    given = [str(tmp_path / "a.md"), str(tmp_path / "b.txt")]
    assert files.discover(given, exclude=("a.md",)) == given[1:]


def many_findings(spark, n):
    """Findings of which a third are of one path, with text that JSON must escape."""
    k = F.col("id")
    return spark.range(n).select(
        F.when(k % 3 == 0, "hot/one.md").when(k % 7 == 0, "a/x.md").otherwise(F.concat(F.lit("a-"), (k % 40).cast("string"), F.lit("/é b.md"))).alias("path"), k.alias("seq"), F.lit("V002").alias("rule_id"), F.concat(F.lit('say "x"\\\n— '), k).alias("message"),
        (k % 90 + 1).cast("int").alias("line"), F.lit(3).alias("column"), F.lit(None).cast("int").alias("end_line"), F.when(k % 4 > 0, 9).alias("end_column"), F.when(k % 5 == 0, "error").when(k % 2 == 0, "info").otherwise("warning").alias("severity"),
        F.when(k % 11 == 0, "low").otherwise("medium").alias("confidence"), F.lit(None).cast("string").alias("suggestion"),
    )


@pytest.mark.parametrize("form", ["text", "json", "jsonl", "sarif"])
def test_written_reports_equal_the_small_form(spark, tmp_path, form):
    small = {"text": lambda f: "\n".join(reports.as_text(f)) + "\n", "json": reports.as_json, "sarif": reports.as_sarif, "jsonl": lambda f: "".join(json.dumps(json.loads(r.value)) + "\n" for r in reports.jsonl(f).collect())}[form]
    for n in (0, 1, 3_000):
        found, path = many_findings(spark, n), tmp_path / f"{n}.{form}"
        path.write_text("what was there before")
        reports.write(found, str(path), form)
        got = path.read_bytes().decode()
        assert got == small(found) and not [x for x in os.listdir(tmp_path) if x.count(".") > 1]
        if form in ("json", "sarif"):
            assert json.dumps(json.loads(got), indent=2) == got
    if form == "json":
        whole = json.loads(got)
        paths = [f["path"] for f in whole["files"]]
        assert paths == sorted(set(paths), key=lambda p: p.split("/")) and whole["summary"]["total_issues"] == 3_000 == sum(len(f["issues"]) for f in whole["files"])


def test_a_failed_report_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text("old")
    broken = many_findings(spark, 500).withColumn("message", F.when(F.col("seq") == 499, F.raise_error(F.lit("no"))).otherwise(F.col("message")))
    with pytest.raises(Exception, match="no"):
        reports.write(broken, str(path), "json")
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["r.json"]


def changes_of(reader, start):
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    return rows, end


def test_watch_gives_modified_files_again(tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    f, g = seen / "f.md", seen / "g.md"
    f.write_text("one")
    g.write_text("two")
    os.utime(f, (100, 100))
    os.utime(g, (100, 100))
    made = lambda: watch.Changes({"paths": json.dumps([str(seen)]), "state": str(tmp_path / "state")})
    reader = made()
    rows, at = changes_of(reader, reader.initialOffset())
    assert sorted(r[2] for r in rows) == ["one", "two"] and changes_of(reader, at) == ([], at)
    f.write_text("three")
    os.utime(f, (200, 200))
    g.unlink()
    reader = made()  # a restart knows what was seen
    before = at
    rows, at = changes_of(reader, at)
    assert [r[2] for r in rows] == ["three"] and reader.versions.state() == {str(f): 200.0}
    assert [r[0] for p in made().partitions(before, at) for r in reader.read(p)] == [str(f)]  # the same batch once more
    old = seen / "old.md"
    old.write_text("older than all")
    os.utime(old, (50, 50))
    bad = seen / "bad.md"
    bad.write_bytes(b"\xff")
    rows, at = changes_of(reader, at)
    assert {os.path.basename(r[0]): r[2] for r in rows} == {"old.md": "older than all", "bad.md": None} and any(r[3] for r in rows)
    for k in range(3 * watch.APART):
        os.utime(f, (300 + k, 300 + k))
        rows, after = changes_of(reader, at)
        assert [r[1] for r in rows] == [300.0 + k]
        at = after
        reader.commit(at)
    assert len(os.listdir(tmp_path / "state")) <= watch.APART + 2
    assert made().versions.state() == {str(f): 299.0 + 3 * watch.APART, str(old): 50.0, str(bad): os.stat(bad).st_mtime}


def test_watch_checks_batches_against_a_baseline(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "in").mkdir(parents=True)
    (docs / "a.md").write_text("Feel free to go. It is world-class.")
    (docs / "in" / "b.md").write_bytes(b"\xff")
    known = spark.createDataFrame([("a.md", "V002", "feel free to", "?")], "path string, rule_id string, match string, context_hash string")
    found = engine.check(files.readable(files.read(spark, [str(docs / "a.md")])))
    known = policy.relative(policy.identities(found, files.read(spark, [str(docs / "a.md")])), str(docs)).where("rule_id = 'V002'").select(*policy.KEY)
    seen, unread = [], []
    query = watch.watch(spark, [str(docs)], lambda f, n: seen.append([(r.path, r.rule_id) for r in f.collect()]), str(tmp_path / "state"), Policy(select={"V002", "V004"}), once=True, baseline=known, workspace=str(docs), on_unreadable=lambda u, n: unread.extend(os.path.basename(r.path) for r in u.collect()))
    query.awaitTermination(120)
    assert query.exception() is None and seen == [[(str(docs / "a.md"), "V004")]] and unread == ["b.md"]
    (docs / "c.md").write_text("Certainly! It is so.")
    query = watch.watch(spark, [str(docs)], lambda f, n: seen.append([(r.path, r.rule_id) for r in f.collect()]), str(tmp_path / "state"), Policy(select={"V002", "V004"}), once=True, baseline=known, workspace=str(docs))
    query.awaitTermination(120)
    assert query.exception() is None and seen[1:] == [[(str(docs / "c.md"), "V002")]]


def test_configuration(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    assert config.find(inner, tmp_path) is None
    (tmp_path / "a" / ".inkgauge.toml").write_text('profile = "academic"\nselect = ["v001", "S"]\n[severity]\nv001 = "error"\n[thresholds]\nanaphora_abuse = 5\n[vocabulary]\nallowed = ["delve"]\n[[per-file-ignores]]\npattern = "x/*.md"\nignore = ["S010"]\n')
    assert config.find(inner, tmp_path) == tmp_path / "a" / ".inkgauge.toml"
    got = config.load(start=inner)
    assert got.policy.select == {"V001", "S"} and got.policy.severity == {"V001": "error"} and got.policy.limits()["anaphora_abuse"] == 5
    assert got.policy.allowed == ("delve",) and got.policy.per_file_ignores == {"x/*.md": {"S010"}} and got.policy.minimum_severity == "info"
    (inner / "pyproject.toml").write_text('[tool.inkgauge]\nminimum_severity = "error"\n')
    assert config.load(start=inner).policy.minimum_severity == "error"
    for bad in ({"colour": 1}, {"profile": "none"}, {"select": "V001"}, {"thresholds": {"anaphora_abuse": 0}}, {"vocabulary": {"x": []}}):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_baseline_of_version_one(spark, tmp_path):
    import hashlib

    text = "one\ntwo here\nthree"
    docs = spark.createDataFrame([("a.md", text)], "path string, content string")
    found = spark.createDataFrame([("a.md", 1, "V002", "m", 2, 5, None, 9, "warning", "medium", None), ("a.md", 2, "V004", "n", 1, 1, None, 4, "warning", "medium", None)], FOUND)
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    print_ = json.dumps({"rule_id": "V002", "message_hash": short("m"), "relative_path": "a.md", "context_hash": short(text)})
    path = tmp_path / "old.json"
    path.write_text(json.dumps({"version": "1.0", "fingerprints": [hashlib.sha256(print_.encode()).hexdigest()[:32], "f" * 32]}))
    state, stale = policy.partition_legacy(policy.legacy_identities(policy.identities(found, docs), docs), reports.load_baseline(spark, str(path)))
    assert {(r.rule_id, r.match, r.state) for r in state.collect()} == {("V002", "here", "active"), ("V004", "one", "new")}
    assert [r.fingerprint for r in stale.collect()] == ["f" * 32]


def tree(root):
    """Folders with ignore files inside each other, negations, anchored and folder rules, links, and a repository inside."""
    made = {
        ".gitignore": "*.log.md\nbuild/\n/only_top.md\ndocs/**/draft*.md\n# no rule\n\\#odd.md\n[ab]?.md\n!keep.log.md\ndeep/a/*/z.md\nspace\\ .md\n",
        "a.md": "", "x.log.md": "", "keep.log.md": "", "only_top.md": "", "a1.md": "", "c1.md": "", "#odd.md": "", "space .md": "", "b.txt": "", "skip.md": "",
        "build/in.md": "", "src/build/in.md": "", "src/only_top.md": "", "src/m.py": "", "src/.gitignore": "*.py\n!important.py\n!x.log.md\n", "src/important.py": "", "src/x.log.md": "", "src/sub/q.py": "",
        "docs/draft1.md": "", "docs/one/draft2.md": "", "docs/one/two/draft3.md": "", "docs/final.md": "", "deep/a/b/z.md": "", "deep/a/z.md": "", "deep/a/b/c/z.md": "",
        "src/sub/.gitignore": "/n.md\n!q.py\n", "src/sub/n.md": "", "src/sub/more/n.md": "", "build2/.gitignore": "*\n!.gitignore\n", "build2/gone.md": "", ".hidden/h.md": "",
    }
    for name, text in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "loop").symlink_to(root, target_is_directory=True)


@pytest.mark.parametrize("git", [True, False])
def test_discovery_by_executors_equals_the_list(spark, tmp_path, git):
    import subprocess

    from inkgauge.sources import discovery

    root = tmp_path / "repo"
    root.mkdir()
    tree(root)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".git" / "info" / "exclude").write_text("c1.md\n")
    for given, exclude in (([str(root)], ("skip.md",)), ([str(root / "src"), str(root / "docs"), str(root / "a.md")], ()), ([str(root / "src" / "sub")], ("more/",))):
        want = set(files.discover(given, exclude=exclude, use_git=git))
        rows = [r.path for r in discovery.discover(spark, given, exclude=exclude, use_git=git).collect()]
        assert set(rows) == want and len(rows) == len(want) and want
    docs = files.read_table(discovery.discover(spark, [str(root / "docs")], use_git=False))
    assert docs.where("read_error is null").count() == docs.count() > 2
    with pytest.raises(FileNotFoundError):
        discovery.discover(spark, [str(root / "none")])


def test_workspaces(spark, tmp_path):
    (tmp_path / "r" / ".git").mkdir(parents=True)
    (tmp_path / "r" / "a" / "b").mkdir(parents=True)
    (tmp_path / "s" / "c").mkdir(parents=True)
    (tmp_path / "r" / "a" / "x.md").write_text("x")
    at = lambda *names: [str(tmp_path / n) for n in names]
    assert baseline.workspace(at("r/a/b", "r/a/x.md")) == baseline.workspace(at("r/a/x.md", "r/a/b")) == str(tmp_path / "r")
    assert baseline.workspace(at("r/a", "s/c")) == str(tmp_path) and baseline.workspace(at("s/c")) == str(tmp_path / "s" / "c")
    folder = lambda *paths: baseline.common_folder(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert folder("/a/b/c.md", "/a/b-d/e.md", None) == "/a" and folder("/a/b/c.md", "/a/b/d/e.md") == "/a/b" and folder("/a.md", "/b/c.md") == "/" and folder("a.md", "b/c.md") == "" and folder(None) is None


def test_life_of_a_baseline(spark, tmp_path):
    (tmp_path / "d").mkdir()
    docs = spark.createDataFrame([(str(tmp_path / "d/a.md"), "Feel free to go.\nIt is world-class."), (str(tmp_path / "d/b.md"), "Certainly! It is so.")], "path string, content string")
    found = spark.createDataFrame(engine.check(docs, Policy(select={"V002", "V004"})).collect(), FOUND)
    path, root = str(tmp_path / "base.json"), str(tmp_path)
    run = lambda f, action: baseline.maintain(spark, f, docs, path, action, root)
    entries = lambda: [(e["path"], e["rule_id"]) for e in json.load(open(path))["entries"]]
    assert run(found.where("rule_id = 'V002'"), "create") == {"format": 2, "active": 0, "stale": 0, "new": 2, "entries": 2} and entries() == [("d/a.md", "V002"), ("d/b.md", "V002")]
    only = found.where("path like '%a.md'")
    assert run(only, "summary") == {"format": 2, "active": 1, "stale": 1, "new": 1, "entries": 2} and len(entries()) == 2
    assert run(only, "update")["entries"] == 3 and ("d/a.md", "V004") in entries()
    assert run(only, "prune") == {"format": 2, "active": 2, "stale": 1, "new": 0, "entries": 2} and entries() == [("d/a.md", "V002"), ("d/a.md", "V004")]
    assert [r.rule_id for r in policy.without_known(found, docs, reports.load_baseline(spark, path), root).collect()] == ["V002"]
    told = policy.legacy_identities(policy.relative(found.where("rule_id = 'V004'"), root), policy.relative(docs, root)).first().fingerprint
    with open(path, "w") as f:
        json.dump({"version": "1.0", "fingerprints": [told, "f" * 32]}, f)
    assert run(found, "summary") == {"format": 1, "active": 1, "stale": 1, "new": 2, "entries": 2}
    assert run(found, "update")["entries"] == 3 == len(entries())
    assert run(found.where("false"), "prune")["entries"] == 0 == len(entries()) and json.load(open(path)) == {"version": 2, "entries": []}
    with pytest.raises(ValueError):
        run(found, "forget")
