"""The registered queries of the diagnostics engine, and the same in DuckDB's SQL where that can express them.

documents have no file names: a document is doc_<id>.md. Invented prose triggers few rules, so most queries read an augmented
corpus: each text gets one of the SNIPPETS after a blank line, by doc_id modulo their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge import examples
from inkgauge.operators import markdown
from inkgauge.plans import baseline, catalog, engine, lexicon
from inkgauge.plans import policy as policies
from inkgauge.plans.policy import Policy
from inkgauge.sources import tables

SNIPPETS = (
    "# The First Big Plan\n\nLet me know if the world-class tool boasts more. In conclusion, here's the kicker for us.\nWe revert back in order to merge together.",
    "# one\n\n### Three deep\n\nAs of my last update the truth is plain. It serves as a key turning point, marking the end.\nLooking ahead, we moved forward; moving forward helps.",
    "##### Five\n\nFew scholars have examined this. This study fills the gap, and a gap in the literature remains.\nA decision was made. Steps will be taken.",
    "Think of it as a game-changing synergy. Imagine a world where past history repeats again.\nNot uncommon: each and every true fact is very unique.",
    "## Results Of Our Work\n\nDespite its size, the plan still faces limits. It's worth noting that the data are clear.\nWe are fully aligned on this and on the same page.",
    "Supporters say yes and critics say no. Put simply, history is clear.\nDue to the fact that we conduct an analysis, make a decision rule.\nThen they made a decision.",
    "Plain words only. Nothing to see in this one.\nAnother plain line follows it here.",
    "### Deep start\n\n# Top\n\nLet's dive in: this section will cover the rest. Here is a groundbreaking paradigm shift.\nThe truth likely lies somewhere in the middle.",
)


def corpus(spark: SparkSession, sf_dir: str, augmented: bool = True) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    extra = F.get(F.array(*map(F.lit, SNIPPETS)), F.pmod("doc_id", F.lit(len(SNIPPETS))).cast("int"))
    content = F.concat("text", F.lit("\n\n"), F.coalesce(extra, F.lit(""))) if augmented else F.col("text")  # a null id has no snippet
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


def _doc_id() -> Column:
    return F.regexp_extract("path", r"doc_(-?\d+)", 1).cast("long").alias("doc_id")


def found(spark: SparkSession, sf_dir: str, rules: set[str], augmented: bool = True, **more: object) -> DataFrame:
    policy = Policy(select=rules, minimum_severity="info", **more)
    return engine.findings(corpus(spark, sf_dir, augmented), policy, python=False, suppress=False)


def _places(df: DataFrame) -> DataFrame:
    return df.select(_doc_id(), "rule_id", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), F.col("end_column").cast("long").alias("end_col"), "message")


def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy(_doc_id()).agg(F.count("*").alias("n"))


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus(spark, sf_dir).select("path", F.inline(markdown.structure(F.col("content"))["lines"]))
    return d.select(_doc_id(), F.col("n").cast("long").alias("line"), F.length("raw").cast("long").alias("width"), F.sha2("raw", 256).alias("sha"))


def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = engine.parsed(corpus(spark, sf_dir, False), python=False).select("path", F.inline("sentences"))
    return d.select(_doc_id(), F.col("sent").cast("long").alias("sent"), "text")


def t008_sentence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(found(spark, sf_dir, {"T008"}, False))


def t010_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(found(spark, sf_dir, {"T010"}, False))


def g031_clause_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(found(spark, sf_dir, {"G031"}, False))


def s022_wall_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, {"S022"}, False).select(_doc_id(), "message")


def s010_anaphora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, {"S010"}, False).select(_doc_id(), "message")


def t002_bold_overuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, {"T002"}, False).select(_doc_id(), "message")


def literal_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(found(spark, sf_dir, {x[0] for x in lexicon.LITERALS}))


def first_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(found(spark, sf_dir, {x[0] for x in lexicon.FIRSTS}))


def all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(found(spark, sf_dir, {"S005", "G001", "G013", "G014"}))


def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = found(spark, sf_dir, {x[0] for x in lexicon.REPLACEMENTS})
    return d.select(_doc_id(), "rule_id", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "suggestion")


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(found(spark, sf_dir, {"M008", "S028", "T001"}))


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog with the findings of phrase and heading rules in the corpus: how many each rule has."""
    counted = found(spark, sf_dir, {x[0] for x in lexicon.LITERALS} | {"M008", "S028", "T001"}).groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))
    return catalog.table(spark).join(counted, "id", "left").select("id", "name", "category", "severity", "confidence", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule, severity and confidence of phrase, sentence and heading rules."""
    d = found(spark, sf_dir, {"V002", "V004", "S003", "S005", "G001", "T008", "T010", "S022", "M008", "S028"})
    return d.groupBy("rule_id", "severity", "confidence").agg(F.count("*").alias("n"))


def policy_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two categories without one rule, from warnings and high confidence on, with an override."""
    return found(spark, sf_dir, {"V002", "V004", "M008", "S028"}, min_confidence="high", severity={"S028": "error"}).select(_doc_id(), "rule_id", "severity", "confidence", F.col("line").cast("long").alias("line"))


def baseline_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a baseline of one rule set against the findings of another."""
    docs = corpus(spark, sf_dir)
    known = policies.identities(found(spark, sf_dir, {"V002", "G004"}), docs)
    now = policies.identities(found(spark, sf_dir, {"V002", "S014"}), docs)
    return policies.partition(now, known).groupBy("rule_id", "state").agg(F.count("*").alias("n"))


def baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each action makes of a baseline of one rule set, against the findings of another: its counts."""
    docs = corpus(spark, sf_dir)
    known = policies.identities(found(spark, sf_dir, {"V002", "G004"}), docs).select(*policies.KEY)
    state = baseline.compare(found(spark, sf_dir, {"V002", "S014"}), docs, known)
    return baseline.summaries(state)


def _example(table: tuple, k: int) -> Column:
    return F.get(F.array(*(F.lit(x[k]) for x in table)), F.pmod("doc_id", F.lit(len(table))).cast("int"))


#: Between a text and the example behind it.
_APART = "\n\n<!-- -->\n\n"
_FOUND = "rule_id", "line", "col", "end_line", "end_col", "severity", "confidence", "message", "suggestion"


def _examples(spark: SparkSession, sf_dir: str, table: tuple, form: str) -> DataFrame:
    """The findings, whole, of the example that each document holds (form: behind or before its text, or before its text as Python comments), of the example's rule and at its lines.

    A comment that no one sees parts an example from the text before it: a text that is itself one short paragraph would lead the example's run of them.
    """
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(_example(table, 0), F.lit(table[0][0])).alias("own"), F.coalesce(_example(table, 1), F.lit(table[0][1])).alias("body"))
    lines = lambda c: F.size(F.split(c, "\n", -1))
    whole = {"behind": F.concat("text", F.lit(_APART), "body"), "before": F.concat("body", F.lit("\n\n"), "text"), "python": F.concat("body", F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))}[form]
    before = lines(F.col("text")) + _APART.count("\n") - 1 if form == "behind" else F.lit(0)
    name = F.concat("own", F.lit(".py" if form == "python" else ".md"))
    docs = docs.select(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), before.cast("string"), (before + lines(F.col("body")) - int(form == "python")).cast("string"), name).alias("path"), whole.alias("content"))
    part = lambda k: F.get(F.split("path", "/"), F.lit(k))
    own = F.substring_index(part(3), ".", 1)
    d = engine.findings(docs, Policy(select={x[0] for x in table}, minimum_severity="info"), python=form == "python", sought=own)
    here = (own == F.col("rule_id")) & (F.col("line") > part(1).cast("int")) & (F.col("line") <= part(2).cast("int"))
    moved = lambda c: (F.col(c) - part(1).cast("int")).cast("long")
    return d.where(here).select(
        F.nullif(part(0), F.lit("")).cast("long").alias("doc_id"), "rule_id", moved("line").alias("line"), F.col("column").cast("long").alias("col"), moved("end_line").alias("end_line"), F.col("end_column").cast("long").alias("end_col"), "severity", "confidence", "message", "suggestion"
    )


def rule_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of Markdown, each on documents that hold an example or a near miss of it behind their text."""
    return _examples(spark, sf_dir, examples.MARKDOWN + examples.MISSES, "behind")


def leading_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir, examples.LEADING, "before")


def python_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of Python, over sources that hold a document's text as comments."""
    return _examples(spark, sf_dir, examples.PYTHON, "python")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        line_table, sentence_table, t008_sentence_length, t010_punctuation, g031_clause_overload, s022_wall_of_text, s010_anaphora, t002_bold_overuse, literal_phrases, first_patterns, all_patterns, replacements,
        heading_levels, rule_catalog, findings_summary, policy_filtered, baseline_partition, baseline_summary, rule_examples, leading_examples, python_examples,
    )
    return {f.__name__: f for f in made}


# --- the same in SQL


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _corpus_sql() -> str:
    bodies = ", ".join(f"({k}, {_sql(body)})" for k, body in enumerate(SNIPPETS))
    return (
        f"snippets(k, body) AS (VALUES {bodies}), corpus AS (SELECT doc_id, coalesce(text, '') || chr(10) || chr(10) || body AS content FROM documents JOIN snippets ON doc_id % {len(SNIPPETS)} = k), "
        "raw_lines AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS raw, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM corpus), "
        # headings are masked up to their text, at the same width
        "lines AS (SELECT doc_id, line, raw, CASE WHEN regexp_matches(raw, '^#{1,6}[ \\t]+') THEN repeat(' ', length(regexp_extract(raw, '^#{1,6}[ \\t]+'))) || raw[length(regexp_extract(raw, '^#{1,6}[ \\t]+')) + 1:] ELSE raw END AS text FROM raw_lines)"
    )


_ABBREVIATIONS = "dr|e\\.g|eq|etc|fig|i\\.e|jr|mr|mrs|ms|no|prof|sr|st|vs"
_QUOTES = "[\"'')\\]”’]*"
_SENTENCES = f"""
marked AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.!?]+{_QUOTES})(\\s)', '\\1' || chr(57344) || '\\2', 'g') AS t FROM documents),
joined AS (SELECT doc_id, regexp_replace(regexp_replace(t, '((?:^|[^A-Za-z.])(?:{_ABBREVIATIONS})\\.[.!?]*{_QUOTES})' || chr(57344), '\\1', 'gi'), '((?:[A-Za-z]\\.)(?:[A-Za-z]\\.)+[.!?]*{_QUOTES})' || chr(57344), '\\1', 'g') AS t FROM marked),
pieces AS (SELECT doc_id, unnest(string_split(t, chr(57344))) AS piece, unnest(range(1, len(string_split(t, chr(57344))) + 1)) AS k FROM joined),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS sent, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS text FROM pieces WHERE regexp_matches(piece, '\\S'))"""


def oracle_sql() -> dict[str, str]:
    word_count = "len(regexp_extract_all(text, '\\S+'))"
    counted = lambda what: f"WITH {_SENTENCES} SELECT doc_id, CAST(sum({what}) AS BIGINT) AS n FROM sentences GROUP BY doc_id HAVING sum({what}) > 0"
    literals = ", ".join(f"({_sql(rule)}, {_sql(f'{label}: ' + chr(39) + p + chr(39))}, {_sql(p.lower())})" for rule, label, phrases in lexicon.LITERALS for p in phrases)
    alls = [(rule, label, p, after, "i" if any_case else "c") for rule, label, patterns, after, any_case in lexicon.ALLS if rule != "T005" for p in patterns]
    every = " UNION ALL ".join(
        f"SELECT doc_id, {_sql(r)} AS rule_id, line, {_sql(label)} AS label, {_sql(after)} AS after, regexp_extract_all(text, {_sql(p)}, 0, '{f}') AS hits, regexp_split_to_array(text, {_sql('(?i)' + p if f == 'i' else p)}) AS gaps FROM lines WHERE regexp_matches(text, {_sql(p)}, '{f}')"
        for r, label, p, after, f in alls
    )
    fixed = " UNION ALL ".join(
        f"SELECT doc_id, '{rule}' AS rule_id, line, length(regexp_split_to_array(text, {_sql('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')})[1]) + 1 AS col, {_sql(to)} AS suggestion, text[length(regexp_split_to_array(text, {_sql('(?i)' + chr(92) + 'b' + p + chr(92) + 'b')})[1]) + 1 + {len(p)}:] AS rest FROM lines WHERE NOT starts_with(raw, '#') AND regexp_matches(text, {_sql(chr(92) + 'b' + p + chr(92) + 'b')}, 'i')"
        for rule, _, _, table in lexicon.REPLACEMENTS
        for p, to in table.items()
    )
    anaphora = f"""WITH {_SENTENCES}, f AS (SELECT doc_id, sent, regexp_extract(text, '^\\S+') AS word FROM sentences),
g AS (SELECT *, sent - row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY sent) AS run FROM f),
r AS (SELECT doc_id, lower(word) AS w, run, count(*) AS n, arg_min(word, sent) AS word FROM g GROUP BY ALL)
SELECT doc_id, 'Anaphora: ' || n || ' consecutive sentences starting with ''' || word || '''' AS message FROM r WHERE n >= 3"""
    small = ", ".join(map(_sql, lexicon.SMALL_WORDS))
    heads = f"""WITH {_corpus_sql()}, h AS (SELECT doc_id, line, length(regexp_extract(raw, '^#+')) AS level, regexp_replace(raw, '^#+\\s+', '') AS title FROM lines WHERE regexp_matches(raw, '^#{{1,6}}\\s+\\S')),
j AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY line) AS before, string_split(title, ' ') AS w FROM h),
m AS (SELECT doc_id, line, level, title, 'M008' AS rule_id, 'Heading level jumps from ' || before || ' to ' || level AS message FROM j WHERE level > before + 1
  UNION ALL SELECT doc_id, line, level, title, 'S028', 'Excessive heading depth: level ' || level || ' heading ''' || title || '''' FROM j WHERE level >= 5
  UNION ALL SELECT doc_id, line, level, title, 'T001', 'Title case heading (consider sentence case)' FROM j WHERE len(w) >= 3 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND lower(x) NOT IN ({small}))) / len(w) > 0.6)
SELECT doc_id, rule_id, CAST(line AS BIGINT) AS line, CAST(level + 2 AS BIGINT) AS col, CAST(level + 2 + length(title) AS BIGINT) AS end_col, message FROM m"""
    value = lambda v: "NULL" if v is None else _sql(v) if isinstance(v, str) else f"{v}::BIGINT"
    places = lambda table: ", ".join(f"({k}, '{rule}', {', '.join(map(value, x))})" for k, (rule, _, found) in enumerate(table) for x in found)
    shown = lambda table: f"WITH e(k, {', '.join(_FOUND)}) AS (VALUES {places(table)}) SELECT doc_id, {', '.join(_FOUND)} FROM documents JOIN e ON coalesce(((doc_id % {len(table)}) + {len(table)}) % {len(table)}, 0) = k"
    known = ", ".join(f"({_sql(rule)}, {_sql(p.lower())})" for rule, _, phrases in lexicon.LITERALS if rule in ("V002", "G004", "S014") for p in phrases)
    clauses = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: x IN ('and', 'but', 'nor', 'or', 'so', 'yet', 'although', 'because', 'if', 'unless', 'whereas', 'while'))"
    overload = (
        f"len({clauses}) + len(regexp_extract_all(lower(text), '\\beven\\s+though\\b')) - len(regexp_extract_all(lower(text), '\\bbecause\\s+of\\b')) + length(text) - length(replace(text, ';', '')) "
        "- len(regexp_extract_all(lower(text), ';\\s*(?:and|but|nor|or|so|yet)\\b'))"
    )
    rules = ", ".join(f"({', '.join(map(_sql, (r.id, r.name, r.category, r.severity, r.confidence)))})" for r in catalog.RULES.values())
    firsts = lambda rules: ", ".join(f"({_sql(rule)}, {_sql(label)}, {_sql(after)}, {_sql(p)})" for rule, label, patterns, after in lexicon.FIRSTS if rule in rules for p in patterns)
    first_places = lambda rules: f"WITH {_corpus_sql()}, p(rule_id, label, after, pattern) AS (VALUES {firsts(rules)}), m AS (SELECT doc_id, rule_id, line, label, after, regexp_extract(text, pattern, 0, 'i') AS hit, length(regexp_split_to_array(text, '(?i)' || pattern)[1]) AS a FROM lines JOIN p ON regexp_matches(text, pattern, 'i')) SELECT doc_id, rule_id, CAST(line AS BIGINT) AS line, CAST(a + 1 AS BIGINT) AS col, CAST(a + 1 + length(hit) AS BIGINT) AS end_col, label || ': ''' || hit || '''' || after AS message FROM m"
    literal_places = f"WITH {_corpus_sql()}, p(rule_id, message, phrase) AS (VALUES {literals}) SELECT doc_id, rule_id, CAST(line AS BIGINT) AS line, CAST(strpos(lower(text), phrase) AS BIGINT) AS col, CAST(strpos(lower(text), phrase) + length(phrase) AS BIGINT) AS end_col, message FROM lines JOIN p ON contains(lower(text), phrase)"
    all_places = f"WITH {_corpus_sql()}, m AS ({every}), e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m), f AS (SELECT doc_id, rule_id, line, label, after, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a FROM e) SELECT doc_id, rule_id, CAST(line AS BIGINT) AS line, CAST(a + 1 AS BIGINT) AS col, CAST(a + 1 + length(hit) AS BIGINT) AS end_col, label || ': ''' || hit || '''' || after AS message FROM f"
    long_sentences = counted(f"CASE WHEN {word_count} > 40 THEN 1 ELSE 0 END")
    punctuation = counted("len(regexp_extract_all(text, '(?:\\.{3,}|…)[!?]+|[!?]{2,}'))")
    walls = f"WITH {_SENTENCES} SELECT doc_id, 'Wall-of-text paragraph: ' || count(*) || ' sentences (threshold 6)' AS message FROM sentences GROUP BY doc_id HAVING count(*) >= 6"
    parted = f"""WITH {_corpus_sql()}, p(rule_id, phrase) AS (VALUES {known}), m AS (SELECT doc_id, rule_id, phrase, raw, strpos(lower(text), phrase) AS a FROM lines JOIN p ON contains(lower(text), phrase)),
i AS (SELECT DISTINCT doc_id, rule_id, phrase, lower(trim(regexp_replace(raw[greatest(a - 32, 1):least(length(raw), a - 1 + length(phrase) + 32)], '\\s+', ' ', 'g'))) AS context FROM m)
SELECT rule_id, CASE rule_id WHEN 'V002' THEN 'active' WHEN 'G004' THEN 'stale' ELSE 'new' END AS state, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY ALL"""
    return {
        "line_table": f"WITH {_corpus_sql()} SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(length(raw) AS BIGINT) AS width, sha256(raw) AS sha FROM raw_lines",
        "sentence_table": f"WITH {_SENTENCES} SELECT doc_id, sent, text FROM sentences",
        "t008_sentence_length": long_sentences,
        "t010_punctuation": punctuation,
        "s022_wall_of_text": walls,
        "s010_anaphora": anaphora,
        "t002_bold_overuse": "SELECT doc_id, 'Bold overuse: ' || len(regexp_extract_all(text, '\\*\\*[^*]+\\*\\*')) || ' bold phrases in paragraph' AS message FROM documents WHERE len(regexp_extract_all(text, '\\*\\*[^*]+\\*\\*')) > 3",
        "literal_phrases": literal_places,
        "first_patterns": first_places({x[0] for x in lexicon.FIRSTS}),
        "all_patterns": all_places,
        "replacements": f"WITH {_corpus_sql()}, m AS ({fixed}) SELECT doc_id, rule_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, suggestion FROM m WHERE NOT (rule_id = 'V011' AND starts_with(suggestion, 'decid') AND regexp_matches(rest, '^\\s+(?:boundary|matrix|model|rule|table|tree)\\b', 'i'))",
        "heading_levels": heads,
        "rule_examples": shown(examples.MARKDOWN + examples.MISSES),
        "leading_examples": shown(examples.LEADING),
        "python_examples": shown(examples.PYTHON),
        "g031_clause_overload": counted(f"CASE WHEN {overload} >= 4 THEN 1 ELSE 0 END"),
        # of the four rules only a skipped level is of high confidence
        "policy_filtered": f"SELECT doc_id, rule_id, 'warning' AS severity, 'high' AS confidence, line FROM ({heads}) WHERE rule_id = 'M008'",
        "baseline_partition": parted,
        "baseline_summary": f"""WITH p AS ({parted}), c AS (SELECT CAST(sum(n) FILTER (state = 'active') AS BIGINT) AS active, CAST(sum(n) FILTER (state = 'stale') AS BIGINT) AS stale, CAST(sum(n) FILTER (state = 'new') AS BIGINT) AS new FROM p)
SELECT 2::BIGINT AS format, active, stale, new, CASE action WHEN 'create' THEN active + new WHEN 'update' THEN active + new + stale WHEN 'prune' THEN active ELSE active + stale END AS entries, action
FROM c, (VALUES ('create'), ('update'), ('prune'), ('summary')) AS a(action)""",
        "findings_summary": f"""SELECT rule_id, severity, confidence, CAST(sum(n) AS BIGINT) AS n FROM (
SELECT 'T008' AS rule_id, 'info' AS severity, 'medium' AS confidence, sum(n) AS n FROM ({long_sentences})
UNION ALL SELECT 'T010', 'info', 'high', sum(n) FROM ({punctuation})
UNION ALL SELECT 'S022', 'info', 'medium', count(*) FROM ({walls})
UNION ALL SELECT rule_id, 'warning', 'medium', count(*) FROM ({literal_places}) WHERE rule_id IN ('V002', 'V004') GROUP BY rule_id
UNION ALL SELECT rule_id, 'warning', 'medium', count(*) FROM ({first_places(('S003',))}) GROUP BY rule_id
UNION ALL SELECT rule_id, CASE rule_id WHEN 'S005' THEN 'warning' ELSE 'info' END, 'medium', count(*) FROM ({all_places}) WHERE rule_id IN ('S005', 'G001') GROUP BY rule_id
UNION ALL SELECT rule_id, CASE rule_id WHEN 'M008' THEN 'warning' ELSE 'info' END, CASE rule_id WHEN 'M008' THEN 'high' ELSE 'medium' END, count(*) FROM ({heads}) WHERE rule_id IN ('M008', 'S028') GROUP BY rule_id)
GROUP BY ALL HAVING sum(n) > 0""",
        "rule_catalog": f"SELECT t.id, name, category, severity, confidence, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES {rules}) AS t(id, name, category, severity, confidence) LEFT JOIN (SELECT rule_id AS id, count(*) AS n FROM (SELECT rule_id FROM ({literal_places}) UNION ALL SELECT rule_id FROM ({heads})) GROUP BY rule_id) f ON t.id = f.id",
    }
