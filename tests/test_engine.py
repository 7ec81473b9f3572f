"""Views, rules and policy on small documents with expectations derived by hand."""

import pytest
from pyspark.sql import functions as F

from inkgauge.plans import catalog, engine, policy
from inkgauge.plans.policy import Policy

DOC = "\n".join(
    [
        "# One",  # 1
        "",
        "It is clear that we won!! See `code!!` and [here](url_here) now.",  # 3
        "A wrapped sentence that",  # 4
        "ends on the next line. Dr. Smith came.",  # 5
        "",
        "### Three",  # 7
        "- item text",  # 8
        "  goes on here",  # 9
        "back to body",  # 10
        "> quoted text",  # 11
        "",
        "```",  # 13
        "never closed!!",  # 14
    ]
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("a.md", DOC), ("empty.md", ""), ("none.md", None)], "path string, content string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def lines_of(docs, column):
    return engine.parsed(docs, python=False).select("path", F.inline(column))


def test_blocks_and_contexts(docs):
    got = {(r.n, r.context) for r in lines_of(docs, "prose").collect()}
    assert got == {(1, "heading"), (3, "body"), (4, "body"), (5, "body"), (7, "heading"), (8, "list_item"), (9, "list_item"), (10, "body"), (11, "blockquote")}


def test_sentences_keep_positions(docs):
    got = {(r.start_line, r.start_col, r.end_line, r.end_col, r.text) for r in lines_of(docs, "sentences").where("start_line between 3 and 5").collect()}
    assert (4, 1, 5, 23, "A wrapped sentence that\nends on the next line.") in got
    assert (5, 24, 5, 39, "Dr. Smith came.") in got  # an abbreviation ends no sentence


def test_masked_code_is_no_prose(docs):
    line = lines_of(docs, "prose").where("n = 3").first()
    assert len(line.text) == len(line.raw) and "code" not in line.text and "url_here" not in line.text


def test_one_scan_and_no_shuffle(docs):
    rules = set(catalog.RULES)
    found = engine.findings(docs, Policy(select=rules, minimum_severity="info"), python=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Union" not in plan


def test_null_and_repeated_paths(spark):
    text = "It ran. It sat."
    rows_ = [("a.md", text), ("a.md", text), (None, text + " Feel free to go."), ("b.txt", "It ran. It sat. It won.\n\n# no heading")]
    found = engine.check(spark.createDataFrame(rows_, "path string, content string"), Policy(select={"S010", "V002", "T001"}, minimum_severity="info"))
    assert sorted(((r.path or ""), r.rule_id, r.seq) for r in found.collect()) == [("", "V002", 1), ("b.txt", "S010", 1)]


def test_long_documents_cost_in_proportion(spark):
    import time

    policy = Policy(select={"T010", "S010", "T015", "V009"}, minimum_severity="info")
    took = {}
    for n in (4_000, 16_000, 32_000):
        text = "".join(f"Word{k} goes (in order) to see what comes!! " for k in range(n))
        df = spark.createDataFrame([("a.md", text)], "path string, content string")
        began = time.time()
        assert engine.findings(df, policy, python=False, suppress=False).where("rule_id = 'T010'").count() == n
        took[n] = time.time() - began
    assert took[32_000] < 3 * took[16_000] + 1


def test_deep_parentheses_and_lists(spark):
    text = "See [a](b(c(d(e(f!!))))) now.\n\n- one\n\n  still!!\n\n- two\nand!! so"
    found = engine.findings(spark.createDataFrame([("a.md", text)], "path string, content string"), Policy(select={"T010"}, minimum_severity="info"), python=False)
    assert sorted((r.line, r.column) for r in found.collect()) == [(5, 8), (8, 4)]


def test_findings(docs):
    found = engine.check(docs, Policy(select={"T010", "G017", "M004", "M007", "M008", "M010"}, minimum_severity="info"), python=False, suppress=False)
    got = {(r.rule_id, r.line, r.column, r.end_line, r.end_column, r.severity, r.confidence) for r in found.collect()}
    assert got == {
        ("G017", 3, 1, 3, 17, "info", "high"),
        ("T010", 3, 24, 3, 26, "info", "high"),
        ("M004", 3, 51, None, 59, "error", "high"),
        ("M010", 3, 45, None, 49, "warning", "high"),
        ("M008", 7, 5, None, 10, "warning", "high"),
        ("M007", 13, 1, None, 4, "error", "high"),
    }


def test_suppression_is_of_the_next_line(spark):
    text = "<!-- inkgauge-ignore-next-line V002 -->\nFeel free to ask. Here is a list.\n\nFeel free to go."
    docs = spark.createDataFrame([("a.md", text)], "path string, content string")
    found = engine.check(docs, Policy(select={"V002"}), python=False)
    assert [(r.line, r.message) for r in found.collect()] == [(4, "Collaborative phrase: 'Feel free to'")]


def test_python_comments_and_docstrings(spark):
    text = '"""A holistic module."""\n\n\ndef load_file(path):\n    """Load file path."""\n    # return path\n    return path  # Feel free to edit\n\n\n# x = 1\n'
    docs = spark.createDataFrame([("a.py", text), ("bad.py", "def (:\n# TODO\n")], "path string, content string")
    found = engine.check(docs, Policy(select={"C"}, minimum_severity="info"))
    got = sorted((r.path, r.rule_id, r.line) for r in found.collect())
    assert ("a.py", "C001", 1) in got and ("a.py", "C003", 7) in got and ("a.py", "C006", 6) in got and ("a.py", "C007", 5) in got and ("a.py", "C008", 10) in got
    assert ("bad.py", "C004", 2) in got


def test_catalog_counts():
    by = {}
    for r in catalog.RULES.values():
        by[r.category] = by.get(r.category, 0) + 1
    assert by == {"code": 7, "grammar": 25, "markup": 10, "structure": 25, "style": 14, "vocabulary": 16}
    assert {p: len(rules) for p, (rules, _, _) in catalog.PROFILES.items()} == {"general": 40, "academic": 45, "business": 44, "journalism": 43, "technical-docs": 79}
    assert len(Policy().rules()) == 22


def test_policy_rejects_what_it_does_not_know():
    with pytest.raises(ValueError, match="did you mean"):
        Policy(select={"V0001"})
    with pytest.raises(ValueError):
        Policy(thresholds={"rule_of_three": 0})


def test_baseline_states(spark, docs):
    found = engine.check(docs, Policy(select={"M004", "M007"}), python=False, suppress=False)
    known = policy.identities(found, docs)
    old = known.where("rule_id = 'M004'").select(*policy.KEY).unionByName(spark.createDataFrame([("a.md", "V001", "x", "0" * 16)], "path string, rule_id string, match string, context_hash string"))
    got = {(r.rule_id, r.state) for r in policy.partition(known, old).collect()}
    assert got == {("M004", "active"), ("M007", "new"), ("V001", "stale")}
    assert [r.rule_id for r in policy.unknown(known, old).collect()] == ["M007"]


@pytest.mark.parametrize("rules, piece", [({"T016", "G022", "V016"}, "take the former and/or it never fails (a b c d) or\n"), ({"T015"}, "it (is (very) nested) here and\n")])
def test_one_long_sentence_costs_in_proportion(spark, rules, piece):
    """A text without full stops is one sentence; its places are counted on from match to match."""
    import time

    policy, took = Policy(select=rules, minimum_severity="info"), {}
    for n in (1_000, 10_000, 20_000):
        df = spark.createDataFrame([("a.txt", piece * n)], "path string, content string")
        began = time.time()
        got = engine.findings(df, policy, python=False, suppress=False).groupBy("rule_id").agg(F.count("*").alias("n"), F.max("line").alias("line"), F.min("column").alias("low"), F.max("column").alias("high")).collect()
        took[n] = time.time() - began
        assert {r.rule_id: (r.n, r.line, r.high) for r in got} == {rule: (n, n, {r.rule_id: r.low for r in got}[rule]) for rule in rules}
    assert took[20_000] < 2.5 * took[10_000] + 1


def test_places_of_wrapped_matches(spark):
    text = "One line that goes\non and a large\nnumber of cases came\nto us, or the\nlatter and/or https://a.b/and/or/c (one two three\nfour) (five six seven) (eight nine ten)."
    df = spark.createDataFrame([("a.md", text)], "path string, content string")
    found = engine.findings(df, Policy(select={"V014", "G022", "T016", "T014", "M009"}, minimum_severity="info"), python=False)
    got = {(r.rule_id, r.line, r.column, r.end_line, r.end_column) for r in found.collect()}
    assert got == {("V014", 2, 8, 3, 10), ("G022", 4, 11, 5, 7), ("T016", 5, 8, 5, 14), ("M009", 5, 15, 5, 35), ("T014", 5, 36, 6, 40)}


def test_demanded_literals_are_demanded():
    """Whatever a pattern matches holds one of its anchors: tried on strings made from the patterns themselves, in any case."""
    import random
    import re

    from inkgauge.functions import anchors
    from inkgauge.plans import lexicon as L

    patterns = [p for table in (L.FIRSTS, L.ALLS, L.MARKDOWN_ALLS, L.COUNTED, L.EVIDENCED) for row in table for p in row[2]] + list(L.INFLECTIONS.values()) + [r"(?:ab|cd)?efg", r"x{2,}yz+abc", r"[^a]bcd|bcde", r"(?i)Ab\\.c(?=d)", r"(?:a|b)(?:c|d)e*"]
    rng, tried = random.Random(3), 0
    for p in patterns:
        known = anchors.anchors(p)
        if known is None or "\\x{" in p:
            continue
        compiled = re.compile(p, re.I)
        for _ in range(60):
            text = drawn(p, rng)
            text = "".join(rng.choice((c.upper(), c.lower())) for c in text)
            for m in compiled.finditer(text):
                tried += 1
                assert any(a in m[0].lower() for a in known), (p, m[0], known)
    assert tried > 4_000 and anchors.anchors(r"(?:a|b)(?:c|d)e*") is None and anchors.anchors(r"a|bcd") is None


def drawn(pattern, rng):
    """A string that the pattern probably matches, by walking its parse as Python's own parser gives it."""
    import re
    from re import _parser

    def walk(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "z"
            elif name == "ANY":
                out += rng.choice("qz ")
            elif name == "IN":
                first = arg[0] if str(arg[0][0]) != "NEGATE" else None
                out += "z" if first is None else chr(rng.choice([x[1] for x in arg if str(x[0]) == "LITERAL"] or [ord({"CATEGORY_SPACE": " ", "CATEGORY_WORD": "w", "CATEGORY_DIGIT": "7"}.get(str(first[1]), "k"))]))
            elif name == "BRANCH":
                out += walk(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += walk(arg[-1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += "".join(walk(inner) for _ in range(rng.randint(low, min(int(high), low + 3))))
        return out

    return walk(_parser.parse(pattern, re.I))


def test_parameters_of_default_lambdas_are_none_of_the_function(spark):
    text = 'def load_file(path, key=lambda x: x, *rest_args, **more):\n    """Load the file path key, rest args and more."""\n'
    found = engine.check(spark.createDataFrame([("a.py", text)], "path string, content string"), Policy(select={"C007"}, minimum_severity="info"))
    assert [(r.rule_id, r.line) for r in found.collect()] == [("C007", 2)]


def test_per_file_ignores_name_no_null_path(spark):
    df = spark.createDataFrame([(None, "Feel free to go."), ("zzz.md", "Feel free to go."), ("d/zzz.txt", "Feel free to go.")], "path string, content string")
    found = engine.check(df, Policy(select={"V002"}, per_file_ignores={"zzz*": {"V"}}))
    assert [r.path for r in found.collect()] == [None]


def test_deep_links_are_masked_in_proportion(spark):
    link = "see [a b](u(v(w(x)))) now. "
    for n in (3, 3_000):
        df = spark.createDataFrame([("a.md", link * n)], "path string, content string")
        line = engine.parsed(df, python=False, sentences=False).select(F.inline("prose")).first()
        assert line.text == link.replace("(u(v(w(x))))", " " * 12) * n or len(line.text) == len(line.raw) and "u(v" not in line.text


def shouting(threshold):
    from inkgauge.functions.text import matches
    from inkgauge.operators.findings import issue, of_each

    spans = lambda r: matches(r["text"], "(?U)WOW")
    every = of_each(F.col("prose"), lambda r: F.transform(spans(r), lambda x: issue("T901", "Shouting", r["n"], x["a"] + 1, x["b"] + 1)))
    return F.filter(every, lambda x: F.size(every) >= threshold)


def test_rules_of_ones_own_obey_the_policy(spark):
    own = catalog.user_rule("T901", "Shouting", shouting, severity="info", confidence="low", applies_to=("markdown",), profiles=("general",), threshold=1)
    text = "WOW it is.\n\nA WOW and WOW.\n\n<!-- inkgauge-ignore-next-line T901 -->\nWOW again."
    df = spark.createDataFrame([("a.md", text), ("b.py", "# WOW\n"), ("c.txt", "WOW")], "path string, content string")
    told = lambda **p: [(r.path, r.line, r.column, r.severity, r.confidence) for r in engine.findings(df, Policy(own=(own,), **p)).where("rule_id = 'T901'").orderBy("line", "column").collect()]
    want = [("a.md", 1, 1), ("a.md", 3, 3), ("a.md", 3, 11)]
    only = {"T901", "V002"}
    assert told(minimum_severity="info", select=only) == [(*w, "info", "medium") for w in want]
    assert told(select=only) == [] and told(minimum_severity="info", select=only, ignore={"T"}) == [] and told(minimum_severity="info", select={"V002"}) == []
    assert told(severity={"T901": "error"}, select=only) == [(*w, "error", "medium") for w in want]
    assert told(minimum_severity="info", select=only, thresholds={"T901": 5}) == []
    assert told(minimum_severity="info", select=only, per_file_ignores={"*.md": {"T901"}}) == []
    assert Policy(own=(own,), minimum_severity="info").rules() - Policy(minimum_severity="info").rules() == {"T901"} and "T901" not in Policy(own=(own,)).rules()
    assert "T901" in Policy.of_profile("general", (own,)).rules() and "T901" not in Policy.of_profile("business", (own,)).rules()
    assert catalog.table(spark, (own,)).where("id = 'T901'").first().config_key == "thresholds.T901"
    for bad in (("T001", "info"), ("X901", "info"), ("T902", "loud")):
        with pytest.raises(ValueError):
            catalog.user_rule(bad[0], "n", shouting, severity=bad[1])
    with pytest.raises(ValueError):
        Policy(select={"T901"})


def test_demands_leave_out_nothing_that_is_found(spark):
    """Rules whose demands are known find the same alone as beside a rule of which nothing is known, for which everything is made."""
    long = "Some " + "word " * 45 + "end."
    texts = [
        f"One. Two.\nThree? {long}\nFour!! Five?! {long}  \n\n# Head\n\n##### Deep\n\nA pivotal moment. B. C. D. E. F. G.   ",
        " ".join([f"Short one {i}." for i in range(70)] + [long, "What?!"]) + "\nLooking ahead, it serves as a Here's a\nboasts `x` end",
        " \n\n", "", "It faces. Despite their best, it still faces.\n> quoted?! " + long, "\n".join(f"{long} No?!" for _ in range(40)),
    ]
    docs = spark.createDataFrame([(f"{i}.{kind}", t) for i, t in enumerate(texts) for kind in ("md", "txt")], "path string, content string")
    chosen = {"V002", "V004", "S003", "S005", "G001", "T008", "T010", "S022", "M008", "S028"}
    fields = ("path", "rule_id", "message", "line", "column", "end_line", "end_column")
    found = lambda rules: sorted(tuple(r) for r in engine.findings(docs, Policy(select=rules, minimum_severity="info"), python=False, suppress=False).where(F.col("rule_id").isin(*chosen)).select(*fields).na.fill(0).collect())
    got = found(chosen)
    assert got == found(chosen | {"V001", "G031", "S016"}) and {x[1] for x in got} == chosen
    made = engine.parsed(docs, False, window=False, lines=False, demand=(80, None, 6)).where("path = '1.md'").select(F.explode("chunks").alias("c")).select("c.n_sents", F.size("c.sents")).first()
    assert made[0] >= 72 and made[1] < 10
