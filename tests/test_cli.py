"""The command line: exit codes, overrides, standard input, reports, baselines, the catalog."""

import json

import pytest

from inkgauge import cli
from inkgauge.plans import catalog


@pytest.fixture
def run(spark, capsys):
    def go(*argv, stdin="", session=True):
        told = []
        code = cli.main(list(argv), (lambda: spark) if session else (lambda: pytest.fail("no session is needed")), told.append, lambda: stdin)
        return code, "\n".join(told), capsys.readouterr().err

    return go


def test_wrong_use_needs_no_session(run, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("x")
    for argv in (["check", "none.md"], ["check", "-"], ["check", "-", "a.md", "--filename", "b.md"], ["check", "a.md", "--filename", "b.md"], ["check", "a.md", "-s", "Q001"], ["check", "a.md", "-b", "none.json"], ["baseline", "prune", "a.md"], ["check", "-", "--filename", "x.md", "-b", "a.md"]):
        code, out, err = run(*argv, session=False)
        assert code == 2 and err and not out, argv
    (tmp_path / ".inkgauge.toml").write_text('colour = "red"\n')
    assert run("check", "a.md", session=False)[0] == 2


def test_what_the_command_line_overrides(run, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("x")
    (tmp_path / ".inkgauge.toml").write_text('profile = "academic"\nignore = ["V002", "T", "S010"]\nmin_confidence = "high"\n')
    told = lambda *argv: dict(x.strip().split(": ", 1) for x in run("check", "a.md", "--show-config", *argv, session=False)[1].split("\n")[1:])
    plain = told()
    assert plain["Ignore"] == "['S010', 'T', 'V002']" and plain["Minimum confidence"] == "high" and plain["Config file"].endswith(".inkgauge.toml")
    assert told("-s", "V,T003")["Ignore"] == "['S010']" and told("-s", "V,T003")["Select"] == "['T003', 'V']"
    assert told("-i", "g001")["Ignore"] == "['G001', 'S010', 'T', 'V002']"
    assert told("--hide-low")["Minimum confidence"] == "medium" and told("--hide-low", "--min-confidence", "low")["Minimum confidence"] == "low"
    assert told("--profile", "business")["Minimum confidence"] == "low" and told("--severity", "error")["Minimum severity"] == "error"


def test_check_files_and_standard_input(run, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("Feel free to go.\n")
    (tmp_path / "docs" / "b.md").write_text("Plain.\n")
    code, out, _ = run("check", "docs", "-s", "V002")
    assert code == 1 and out.startswith("docs/a.md:1:1: V002 [warning] Collaborative phrase: 'Feel free to'")
    assert run("check", str(tmp_path / "docs"), "-s", "V002")[1].startswith(f"{tmp_path}/docs/a.md:1:1: ")
    code, out, _ = run("check", "docs", "-s", "V002", "-f", "json", "-o", "report.json")
    told = json.loads((tmp_path / "report.json").read_text())
    assert code == 1 and not out and told["summary"]["files_checked"] == 2 and len(told["files"]) == 1
    assert run("check", "docs/b.md", "-s", "V002")[:2] == (0, "No issues found!")
    code, out, _ = run("check", "-", "--filename", "x.md", "-s", "V002", "-f", "jsonl", stdin="One.\r\nFeel free to go.")
    assert code == 1 and json.loads(out)["line"] == 2 and json.loads(out)["path"] == "x.md"
    (tmp_path / "docs" / "bad.md").write_bytes(b"\xff")
    code, out, err = run("check", "docs", "-s", "V002")
    assert code == 3 and "V002" in out and "bad.md: UnicodeDecodeError" in err


def test_baseline_commands(run, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("Feel free to go.\n")
    assert run("baseline", "create", "a.md", "-s", "V002", "-b", "base.json")[:2] == (0, "Baseline create: base.json\n  Format: 2\n  Active: 0\n  Stale: 0\n  New: 1\n  Entries: 1")
    assert json.loads((tmp_path / "base.json").read_text())["entries"][0]["path"] == "a.md"
    assert run("check", "a.md", "-s", "V002", "-b", "base.json")[0] == 0
    (tmp_path / "base.json").write_text("{}")
    assert run("baseline", "summary", "a.md", "-s", "V002", "-b", "base.json")[0] == 2


def test_the_catalog(run, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert len(json.loads(run("rules", "-f", "json", session=False)[1])) == 97 and run("rules", session=False)[1].count("\n") == 96
    assert json.loads(run("explain", "v001", "-f", "json", session=False)[1])["id"] == "V001" and run("explain", "x", session=False)[0] == 1
    assert "config_key: -" in run("explain", "V001", session=False)[1] and run("version", session=False)[1].startswith("inkgauge ")
    assert run("init", session=False)[0] == 0 and run("init", session=False)[0] == 2
    from inkgauge.sources import config

    assert config.load(start=tmp_path).policy.minimum_severity == "warning"
    page = tmp_path / "page.md"
    page.write_text("Top\n<!-- inkgauge:categories:start -->old<!-- inkgauge:categories:end -->\n<!-- inkgauge:rules:start --><!-- inkgauge:rules:end -->\nEnd\n")
    assert run("docs", "page.md", session=False)[:2] == (1, "Stale: page.md") and "old" in page.read_text()
    assert run("docs", "page.md", "--write", session=False)[0] == 0 and run("docs", "page.md", session=False)[:2] == (0, "")
    assert page.read_text().count("| `V") == 17 and f"**{len(catalog.RULES)}**" in page.read_text() and page.read_text().startswith("Top\n") and page.read_text().endswith("\nEnd\n")
    page.write_text("<!-- inkgauge:rules:end --><!-- inkgauge:rules:start -->")
    assert run("docs", "page.md", session=False)[0] == 2
