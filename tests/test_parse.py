"""Shorter ways through the parse give what the whole way gives."""

from pyspark.sql import functions as F

from inkgauge.functions.text import has, let, scan
from inkgauge.operators import markdown, prose
from inkgauge.plans import engine
from inkgauge.plans.policy import Policy

ODD = (
    "", "One. Two!! Three?", "a and b or c; so d\nbut e because\n\nof it", " lead\n \t\nnext and\u0085more. Done", "import x from 'y'\ntext and", "plain\n===\nmore", "title\n---\nbody!!", "---\na: b\n---\ntext?!", "1. one\n  goes on\nand off",
    "٣) arabic\nnext", "- \na\n- b!!", "a\n1. \nb and c or d so e", "> quoted and or so\nbut yet!!", "x `a and b or` c ; d; e; f", "| a | b |\ntail", "# Head!!\nbody", "~~~\ncode!!\n~~~\nout...!", "<div>\nin!!\n</div>\nout", "+ item\n\n* star\nplain", "export default x\nwords",
    "Say dr. who and mr. x or y so z yet w! “Yes.” next\rline\r\nlast  \n", "even though a, even\nif b, because of c; and d while e", "because\n\nof one and two or three so four", "e.g. this. A.B. that.  Wide   gap.\n\n\nEnd ￿ here.",
)


def _documents(spark):
    return spark.createDataFrame([(f"d{k}.md", t) for k, t in enumerate(ODD)] + [("null.md", None), ("p.py", 'x = 1  # so and or but yet!!\n"""No!! doc."""\n')], "path string, content string")


def test_texts_without_marks_are_plain_prose(spark):
    d = _documents(spark).where("content is not null and path like '%.md'").select("content", markdown.structure(F.col("content"))["lines"].alias("lines"))
    d = d.select("content", markdown.prose(F.col("lines"), F.transform("lines", lambda r: F.lit(False))).alias("whole"), engine._plain(F.col("content"), True).alias("plain"), has(F.col("content"), markdown.MARKS).alias("marked"))
    rows = d.collect()
    assert [r.content for r in rows if not r.marked and r.whole != r.plain] == []
    assert 5 <= sum(not r.marked for r in rows) < len(rows)


def test_documents_left_out_have_no_findings(spark):
    docs = _documents(spark).union(_documents(spark).select("path", F.concat("content", F.lit("\n\nIt is and, but, or so; yet, if not."))))
    for rule in ("T010", "G031"):
        only = engine.findings(docs, Policy(select={rule}, minimum_severity="info"), suppress=False)
        more = engine.findings(docs, Policy(select={rule, "T012"}, minimum_severity="info"), suppress=False).where(F.col("rule_id") == rule)  # T012 leaves no document out
        assert sorted(map(repr, only.collect())) == sorted(map(repr, more.collect())) != []
    assert engine._open_documents(_documents(spark), {"T010"}).count() < _documents(spark).count()


def test_sentences_of_docstrings_alone(spark):
    text = 'def load_file(path):  # A note. Two.\n    """Load the file path.  More.\n\n    Rest."""  # beside. it\n    # below. it\n    return 1\n'
    docs = spark.createDataFrame([("a.py", text)], "path string, content string")
    said = engine.parsed(docs, chunks=False, docstrings=True).select(F.inline("sentences")).select("text", "start_line").collect()
    assert said[0].text == "Load the file path." and {r.start_line for r in said} == {2, 4}  # not lines 1 and 5
    found = lambda rules: sorted(map(repr, engine.findings(docs, Policy(select=rules, minimum_severity="info")).where("rule_id = 'C007'").collect()))
    assert found({"C007"}) == found({"C007", "T008"}) and len(found({"C007"})) == 1


def test_folds_of_any_length(spark):
    """Sums of runs, over the borders of inner and outer folds."""
    step = lambda s, x: let(s + x, lambda t: F.struct(t.alias("state"), t.alias("out")))
    d = spark.createDataFrame([(n,) for n in (0, 1, 11, 12, 13, 143, 144, 145, 1000)], "n int").select("n", F.expr("if(n = 0, cast(array() as array<int>), sequence(1, n))").alias("v"))
    for r in d.select("n", scan(F.col("v"), F.lit(0), step, "int").alias("out")).collect():
        assert r.out == [k * (k + 1) // 2 for k in range(1, r.n + 1)]


def test_places_of_sentences(spark):
    text = F.lit(" \n One. Two\ngoes on!\n\n Three  ")
    got = spark.range(1).select(prose.split_sentences(text, F.lit(7), lambda x: x).alias("v")).first().v
    assert [tuple(x) for x in got] == [("One.", 3, 8, 2, 8, 6), ("Two\ngoes on!", 8, 8, 7, 9, 9), ("Three", 23, 11, 2, 11, 7)]
