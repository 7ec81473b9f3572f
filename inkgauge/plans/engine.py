"""Documents in, findings out: each document is parsed, judged and filtered inside its own row.

A document's lines, headings, prose, chunks and sentences are arrays of its row. Rules over a whole document are columns of that row;
its prose lines and sentences are then exploded once, together, and rules of one line or sentence are columns of those. So any number of
rules costs one scan and no shuffle; only the numbering of findings by path, where it is asked for, moves the findings.

Defined cases: a null content is an empty document; a null path is a document of no known kind, read as plain text; documents that share a
path are judged apart and their findings numbered together. Names that end in .md, .mdx or .markdown are Markdown, .py is Python, all else plain text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions.text import built_once, flat, groups, has, is_blank, kept, let, without_call_sites
from inkgauge.operators import line_rules, markdown, markdown_rules, prose, python_source, sentence_rules
from inkgauge.operators.findings import NONE
from inkgauge.plans import policy as policies
from inkgauge.plans.policy import Policy

MARKDOWN, PYTHON = r"(?i)\.(md|mdx|markdown)$", r"(?i)\.py$"
FINDING = "path string, seq long, rule_id string, message string, line int, column int, end_line int, end_column int, severity string, confidence string, suggestion string"
COLUMNS = ["path", "rule_id", "message", "line", "column", "end_line", "end_column", "severity", "confidence", "suggestion"]
_NO_LINES = "cast(array() as array<struct<n:int,raw:string,q:int,s:string,code:boolean,html:boolean,front:boolean,mdx:boolean>>)"
_NO_FENCES = "cast(array() as array<struct<a:int,b:int,closed:boolean,fence:string,col:int>>)"


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed here and nowhere else: a generator keeps the optimizer from copying them to where they are read."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _joined(arrays: list[Column]) -> Column:
    """One array of several; joining a single one would cost as much as two."""
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def _kinded(documents: DataFrame) -> DataFrame:
    path = F.coalesce("path", F.lit(""))
    return documents.select("path", F.coalesce("content", F.lit("")).alias("content")).withColumns({"is_markdown": F.rlike(path, F.lit(MARKDOWN)), "is_python": F.rlike(path, F.lit(PYTHON))})


def _plain(content: Column, known: bool = False) -> Column:
    """Prose of a text of no known kind, or of Markdown without marks: runs of lines that aren't blank."""
    lines = F.transform(F.split(content, "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("raw")))
    runs = groups(F.filter(lines, lambda r: ~is_blank(r["raw"])), lambda a, b: b["n"] == a["n"] + 1)
    row = lambda r, k: F.struct(r["n"], r["raw"], r["raw"], F.lit("body"), k + 1, k + 1, F.lit(0), F.lit(False), F.lit(False), F.lit(known)).cast(markdown.PROSE)
    return flat(F.transform(runs, lambda g, k: F.transform(g, lambda r: row(r, k))))


@built_once
def _parse_columns(lines: bool = True) -> dict[str, Column]:
    """What is parsed of a text that isn't Python, each over the columns before it. lines: those of Markdown without marks too, which its headings and prose don't need."""
    none = F.struct(F.expr(_NO_LINES).alias("lines"), F.expr(_NO_FENCES).alias("fences"))
    return {
        "structure": F.when(F.col("is_markdown") if lines else F.col("is_markdown") & has(F.col("content"), markdown.MARKS), markdown.structure(F.col("content"))).otherwise(none),
        "heads": markdown.headings(F.col("lines")),
        "example": markdown.examples(F.col("heads"), F.size("lines")),
        "prose": F.when(~F.col("is_markdown"), _plain(F.col("content"))).when(has(F.col("content"), markdown.MARKS), markdown.prose(F.col("lines"), F.col("example"))).otherwise(_plain(F.col("content"), True)),
    }


@built_once
def _sentence_columns(window: bool, chunks: bool, docstrings: bool, demand: tuple | None = None, readers: frozenset[str] | None = None) -> dict[str, Column]:
    """Chunks and sentences; sentences alone are made in one go, and chunks are never a column. A docstring's lines are whole chunks, as is a comment beside one. readers: only where one of these rules is sought."""
    lines = F.col("prose") if readers is None else F.when(F.col("sought").isin(*sorted(readers)), F.col("prose")).otherwise(F.expr(f"cast(array() as array<{markdown.PROSE}>)"))
    if docstrings:
        lines = F.filter(lines, lambda r: F.exists("docstrings", lambda d: r["n"].between(d["line"], d["end_line"])))
    made = prose.chunks(lines, window, demand)
    return {"chunks": made, "sentences": prose.sentences(F.col("chunks"))} if chunks else {"sentences": prose.sentences(made)}


@without_call_sites()
def parsed(documents: DataFrame, python: bool = True, sentences: bool = True, window: bool = True, chunks: bool = True, docstrings: bool = False, lines: bool = True, demand: tuple | None = None, sought: Column | None = None, readers: frozenset[str] | None = None) -> DataFrame:
    """The documents (path, content) with lines, fences, heads, example, prose, and where wanted chunks and sentences; Python's with their facts as well. docstrings: sentences of docstrings' lines alone.

    lines: Markdown without marks has lines too. demand: those sentences alone that meet it. sought: the rule that each document is read for, by its path, as a column; only for readers it has sentences.
    """
    docs, made = _kinded(documents), _parse_columns(lines)
    text = docs.where(~F.col("is_python")).drop("is_python")
    text = _made(text, structure=made["structure"]).select("*", "structure.*").drop("structure")
    for name in ("heads", "example", "prose"):
        text = _made(text, **{name: made[name]})
    whole = text.withColumn("python", F.lit(False))
    if python:
        facts = _made(python_source.parsed(docs.where("is_python")), raws=F.split("content", "\n", -1))
        facts = _made(facts, prose=python_source.prose())
        whole = whole.unionByName(facts.withColumn("python", F.lit(True)), allowMissingColumns=True)
    if sought is not None:
        whole = _made(whole, sought=sought)
    if sentences:
        for name, column in _sentence_columns(window, chunks, docstrings and python, demand, None if sought is None else readers).items():
            whole = _made(whole, **{name: column})
    return whole


@built_once
def _document_rules(chosen: frozenset[str], thresholds: tuple, python: bool) -> list[Column]:
    """Rules over a whole document, each an array of issues. Those of Markdown have nothing to read in others and the other way round."""
    limits = dict(thresholds)
    out = line_rules.counted(chosen, limits) + sentence_rules.grouped(chosen, limits) + markdown_rules.heading_rules(chosen)
    single = {
        "T007": lambda: sentence_rules.punchy_fragments(limits["short_punchy_fragments"]),
        "T015": sentence_rules.nested_parentheses,
        "S012": sentence_rules.listicles,
        "G002": sentence_rules.hedging,
        "G038": sentence_rules.comparatives,
        "S025": markdown_rules.empty_headings,
        "S029": markdown_rules.tiny_sections,
        "T002": lambda: markdown_rules.bold_overuse(limits["bold_overuse"]),
        "S004": lambda: markdown_rules.label_lists(limits["inline_header_lists"]),
        "M007": markdown_rules.unclosed_fences,
        "S016": markdown_rules.repeated_paragraphs,
    }
    out += [make() for rule, make in single.items() if rule in chosen]
    if chosen & {"M003", "M004", "M005", "M010"}:
        out.append(markdown_rules.reference_rules(chosen))
    if python:
        out += python_source.rules(chosen)
    return [F.coalesce(x, F.expr(NONE)) for x in out]


def _own_rules(policy: Policy) -> dict[str, Column]:
    """The chosen rules of one's own, on the kinds of documents that they apply to. Their columns read null where a kind of document lacks what they need."""
    chosen, limits, out = policy.rules(), policy.limits(), {}
    for u in (u for u in policy.own if u.rule.id in chosen):
        kinds = {"markdown": F.coalesce("is_markdown", F.lit(False)), "python": F.col("python")}
        applies = reduce(lambda a, b: a | b, (kinds[k] for k in u.rule.applies_to))
        out[u.rule.id] = F.coalesce(F.when(applies, u.make(limits.get(u.rule.id))), F.expr(NONE))
    return out


@built_once
def _row_rules(chosen: frozenset[str], thresholds: tuple, vocabulary: tuple) -> tuple[list[Column], list[Column]]:
    """Rules over one line, and over one sentence."""
    return line_rules.row_rules(chosen, dict(vocabulary)), sentence_rules.row_rules(chosen, dict(thresholds))


_suppressions = built_once(policies.suppressions)


#: Fields of a unit: what rules of a line and rules of a sentence read, and the findings of the whole document.
_LINE = ("n", "raw", "text", "low", "met", "context", "scope", "example", "markdown")
_SENTENCE = ("sent", "start_line", "start_col", "end_line", "end_col")
#: What only rules that look at neighbouring sentences read.
_WINDOW = ("window", "next_text")
_LOWERED = {"V005", "V008", "S019"}
_NEIGHBOURS = {"V005", "V008", "V014", "V015", "V016", "S017"}
_KINDS = {
    "n": "int", "raw": "string", "text": "string", "low": "string", "met": "array<string>", "context": "string", "scope": "int", "example": "boolean", "markdown": "boolean", "sent": "int", "start_line": "int", "start_col": "int",
    "end_line": "int", "end_col": "int", "window": "string", "next_text": "string",
}


def _unit(kind: str, fields: dict[str, Column], issues: Column | None = None) -> Column:
    given = [fields.get(c, F.lit(None)).cast(t).alias(c) for c, t in _KINDS.items()]
    return F.struct(F.lit(kind).alias("unit"), *given, (F.expr(NONE) if issues is None else issues).alias("issues"))


def _of_sought(rules: dict[str, Column]) -> Column:
    """What the rule gives that is sought in a document: no other is worked out."""
    return reduce(lambda out, x: out.when(F.col("sought") == x[0], x[1]), rules.items(), F).otherwise(F.expr(NONE))


def _judged_sought(docs: DataFrame, policy: Policy, python: bool, suppress: bool) -> DataFrame:
    """As judged(), where each document is searched for its one rule (sought): whole, but the other rules cost nothing there."""
    chosen, limits = policy.rules(), tuple(sorted(policy.limits().items()))
    words = _words(policy)
    whole, of_line, of_sentence, demanded = {}, {}, {}, {}
    for rule in sorted(chosen & set(policies.catalog.RULES)):
        alone = frozenset({rule})
        made = _document_rules(alone, limits, python), *_row_rules(alone, limits, words)
        for found, into in zip(made, (whole, of_line, of_sentence)):
            if found:
                into[rule] = _joined(found)
        if rule in of_line and (literals := line_rules.demanded(alone)) is not None:
            demanded[rule] = line_rules.met(literals)
    whole |= _own_rules(policy)
    units, parts = [], []
    if whole:
        units.append(F.array(_unit("document", {}, _of_sought(whole))))
        parts.append(F.col("issues"))
    if of_line:
        said = reduce(lambda out, x: out.when(F.col("sought") == x[0], x[1]), demanded.items(), F) if demanded else F.lit(None)
        docs = _made(docs, said=said.cast("array<string>"))
        held = lambda low: F.filter("said", lambda a: F.contains(low, a))
        lines = F.filter("prose", lambda r: F.col("sought").isin(*of_line) & (F.col("said").isNull() | let(F.lower(r["text"]), lambda low: F.exists("said", lambda a: F.contains(low, a)))))
        units.append(F.transform(lines, lambda r: let(F.lower(r["text"]), lambda low: _unit("line", {c: low if c == "low" else r[c] for c in _LINE if c != "met"} | {"met": held(low)}))))
        parts.append(F.when(F.col("unit") == "line", _of_sought(of_line)).otherwise(F.expr(NONE)))
    if of_sentence:
        rows = F.filter("sentences", lambda s: F.col("sought").isin(*of_sentence))
        units.append(F.transform(rows, _sentence_unit(chosen)))
        parts.append(F.when(F.col("unit") == "sentence", _of_sought(of_sentence)).otherwise(F.expr(NONE)))
    return _found(docs, units, parts, python, suppress, ["sought"])


def _words(policy: Policy) -> tuple:
    return tuple((name, tuple(getattr(policy, name))) for name in ("allowed", "additional", "allowed_phrases"))


def _sentence_unit(chosen: frozenset[str]) -> Callable[[Column], Column]:
    read = ("text", "context", "scope", "example", "markdown", *_SENTENCE, *(_WINDOW if chosen & _NEIGHBOURS else ()))
    return lambda s: _unit("sentence", ({"low": F.lower(s["text"])} if chosen & _LOWERED else {}) | {c: s[c] for c in read})


def _found(docs: DataFrame, units: list[Column], parts: list[Column], python: bool, suppress: bool, more: list[str] | None = None, columns: dict[str, Column] | None = None) -> DataFrame:
    """path and x, an issue of a part of a unit, where no directive suppresses it. more: columns of the documents that parts read; columns: those made of each unit."""
    if not units:
        return docs.select("path", F.explode(F.expr(NONE)).alias("x"))
    sup = F.expr(f"cast(array() as {policies.DIRECTIVES})")
    if suppress:
        sup = _suppressions(True)
        if python:
            sup = F.when(F.col("python"), _suppressions(False)).otherwise(sup)
    each, kept = _made(docs, sup=sup) if suppress else docs, ["path", *(["sup"] if suppress else [])]
    each = each.select(*kept, *(more or []), F.explode(_joined(units)).alias("u")).select(*kept, *(more or []), "u.*")
    if columns:
        each = _made(each, **columns)
    found = each.select(*kept, F.explode(_joined(parts)).alias("x"))
    return found.where(~policies.suppressed(F.col("sup"), F.col("x"))).select("path", "x") if suppress else found


@without_call_sites()
def judged(docs: DataFrame, policy: Policy, python: bool = True, suppress: bool = True, sought: bool = False) -> DataFrame:
    """The findings of parsed documents, without numbers: path, x (an issue) in one pass. sought: each document has a rule of that name, and is judged by it alone."""
    if sought:
        return _judged_sought(docs, policy, python, suppress)
    chosen, limits = frozenset(policy.rules()), tuple(sorted(policy.limits().items()))
    whole = _document_rules(chosen & frozenset(policies.catalog.RULES), limits, python) + list(_own_rules(policy).values())
    of_line, of_sentence = _row_rules(chosen, limits, _words(policy))
    units = []
    lowered = {"low": F.lower(F.col("text"))} if of_line or chosen & _LOWERED else {}
    rows = "prose" if of_line else "sentences"
    said = line_rules.demanded(chosen) if of_line else None
    alone = bool(of_line) + bool(of_sentence) == 1 and not whole and said is None  # lines or sentences are rows as they are
    if said is not None:
        docs = _made(docs, said=line_rules.met(said))
    if alone:
        units.append(F.col(rows))
    if whole:
        units.append(F.array(_unit("document", {}, F.concat(*whole))))
    if of_line and not alone:
        line = lambda r, low, met: _unit("line", {c: low if c == "low" else r[c] for c in _LINE if c != "met"} | met)
        if said is None:
            units.append(F.transform("prose", lambda r: line(r, F.lower(r["text"]), {})))
        else:  # only lines that hold what a rule demands
            lines = F.filter("prose", lambda r: let(F.lower(r["text"]), lambda low: F.exists("said", lambda a: F.contains(low, a))))
            units.append(F.transform(lines, lambda r: let(F.lower(r["text"]), lambda low: line(r, low, {"met": F.filter("said", lambda a: F.contains(low, a))}))))
    if of_sentence and not alone:
        units.append(F.transform("sentences", _sentence_unit(chosen)))
    parts = [*of_line, *of_sentence] if alone else [F.col("issues")] if whole else []
    if of_line and not alone:
        parts.append(F.when(F.col("unit") == "line", _joined(of_line)).otherwise(F.expr(NONE)))
    if of_sentence and not alone:
        parts.append(F.when(F.col("unit") == "sentence", _joined(of_sentence)).otherwise(F.expr(NONE)))
    return _found(docs, units, parts, python, suppress, columns=lowered if alone else None)


@without_call_sites()
def findings(documents: DataFrame, policy: Policy | None = None, python: bool = True, suppress: bool = True, sought: Column | None = None) -> DataFrame:
    """Findings of documents (path, content) in no order and without numbers: no shuffle at all. place orders those of a rule in a document.

    sought: the one chosen rule that is looked for in a document, of its path; as if all were and the others' findings dropped, without their cost.
    """
    policy = policy or Policy()
    chosen = policy.rules()
    own = bool(chosen - set(policies.catalog.RULES))
    of_sentences = chosen - _LINE_ONLY - _FACTS_ONLY
    docs = parsed(_open_documents(documents, chosen), python, bool(of_sentences), bool(chosen & _NEIGHBOURS) or own, bool(chosen & _CHUNKS) or own, of_sentences == {"C007"}, own or not chosen <= _NO_LINES_READ, None if own else sentence_rules.demand(frozenset(of_sentences), policy.limits()), sought, frozenset(of_sentences))
    found = judged(docs, policy, python, suppress, sought is not None)
    return policies.finish(found.select("path", "x.*"), policy).select(*COLUMNS, "place")


#: Rules that read neither chunks nor sentences.
_LINE_ONLY = {x[0] for table in (line_rules.L.LITERALS, line_rules.L.FIRSTS, line_rules.L.ALLS, line_rules.L.MARKDOWN_ALLS, line_rules.L.REPLACEMENTS, line_rules.L.COUNTED) for x in table} | {
    "V001", "V007", "S004", "S007", "S008", "S009", "S013", "S016", "S021", "S025", "S028", "S029", "T001", "T002", "T003", "T004", "G003", "M003", "M004", "M005", "M006", "M007", "M008", "M010",
}
#: Rules that read no lines of Markdown but its prose, sentences and headings.
_NO_LINES_READ = {x[0] for table in (line_rules.L.LITERALS, line_rules.L.FIRSTS, line_rules.L.ALLS, line_rules.L.REPLACEMENTS) for x in table} | {"T008", "T010", "G031", "S010", "S022", "M008", "S028", "T001"}
#: What a document's content must hold, so often, for a rule to find anything: places that no mask, join or cut of lines can make. Rules that aren't listed may find anything anywhere.
_DEMANDS = {
    "T010": (line_rules.L.REPEATED_PUNCTUATION, 1),
    "G031": (r"(?iU)\b(?:and|but|nor|or|so|yet|although|because|if|though|unless|whereas|while)\b|;", 4),
}


def _open_documents(documents: DataFrame, chosen: set[str]) -> DataFrame:
    """The documents in which the chosen rules may find something: one search of each, before they are parsed."""
    if not chosen or not chosen <= set(_DEMANDS):
        return documents
    found = [has(F.col("content"), regex) if least == 1 else F.regexp_count("content", F.lit(regex)) >= least for regex, least in (_DEMANDS[rule] for rule in sorted(chosen))]
    return documents.where(reduce(lambda a, b: a | b, found))


#: Rules that read facts of Python sources but no sentences.
_FACTS_ONLY = {"C001", "C002", "C003", "C004", "C006", "C008", "M001"}
#: Rules that read chunks.
_CHUNKS = {"S012", "S022", "T006", "T007", "T015"}


def numbered(found: DataFrame) -> DataFrame:
    """Findings with seq, their order inside a path: by rule and then in the rule's own order."""
    seq = F.row_number().over(Window.partitionBy("path").orderBy("rule_id", "place", "line", "column", "message")).cast("long")
    return found.withColumn("seq", seq).select("path", "seq", *COLUMNS[1:])


def check(documents: DataFrame, policy: Policy | None = None, python: bool = True, suppress: bool = True) -> DataFrame:
    """Findings of documents (path, content): path, seq, rule_id, message, line, column, end_line, end_column, severity, confidence, suggestion."""
    return numbered(findings(documents, policy, python, suppress))
