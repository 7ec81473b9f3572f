"""Python sources: one Arrow batch function reads syntax trees and tokens; what it finds becomes arrays of the document's row.

Syntax trees and tokens can't be had from Spark's own functions, so this is the one place outside them. It tells facts only
(docstrings, comments, strings and their places); blocks, chunks and rules are made by Spark.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.ship import ship
from inkgauge.functions.text import first, flat, groups, has, indent, is_blank, let, matches
from inkgauge.operators.findings import issue, none, of_each, quoted, rows
from inkgauge.operators.markdown import PROSE
from inkgauge.plans import lexicon as L

#: Parts of an identifier: runs of capitals, capitalised or lower-case words, numbers.
IDENTIFIER_WORD = r"[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z]?[a-z]+|[A-Z]+|\d+"
_WORD = re.compile(IDENTIFIER_WORD)
#: What a comment may say of a statement, and the way from the statement to the name that it is about.
_TELLINGS = {
    ast.Return: (("return",), ("value",)),
    ast.Assign: (("assign", "set"), ("targets", "only")),
    ast.AnnAssign: (("assign", "set"), ("target",)),
    ast.Expr: (("call",), ("value", "func")),
}
#: Statements that commented-out code may be.
_CODE = (
    ("assignment", (ast.Assign, ast.AugAssign, ast.AnnAssign)),
    ("call", (ast.Expr,)),
    ("import", (ast.Import, ast.ImportFrom)),
    ("control statement", (ast.If, ast.For, ast.While, ast.With)),
)
_OWNERS = {ast.Module: "module", ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}

_SPANS = pa.list_(pa.struct([("n", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
_FACTS = pa.schema(
    [
        ("path", pa.string()),
        ("content", pa.string()),
        ("parses", pa.bool_()),
        ("docstrings", pa.list_(pa.struct([("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("words", pa.list_(pa.string())), ("spans", _SPANS)]))),
        ("comments", pa.list_(pa.struct([("line", pa.int32()), ("col", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("inline", pa.bool_()), ("meta", pa.bool_()), ("restates", pa.bool_()), ("code", pa.string())]))),
        ("strings", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
    ]
)
SCHEMA = (
    "path string, content string, parses boolean, docstrings array<struct<kind:string,line:int,end_line:int,words:array<string>,spans:array<struct<n:int,a:int,b:int>>>>, "
    "comments array<struct<line:int,col:int,end:int,text:string,inline:boolean,meta:boolean,restates:boolean,code:string>>, strings array<struct<a:int,b:int>>"
)


def identifier_words(text: str) -> tuple[str, ...]:
    return tuple(w.casefold() for w in _WORD.findall(text))


def _tokens(content: str) -> list[tokenize.TokenInfo]:
    """The tokens up to the first error."""
    found: list[tokenize.TokenInfo] = []
    try:
        found.extend(tokenize.generate_tokens(io.StringIO(content).readline))
    except (tokenize.TokenError, SyntaxError):
        lines = iter(tokenize.generate_tokens(io.StringIO(content).readline))
        found = []
        while True:
            try:
                found.append(next(lines))
            except (StopIteration, tokenize.TokenError, SyntaxError):
                break
    return found


def _tree(content: str) -> ast.Module | None:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _told(node: ast.stmt) -> set[tuple[str, ...]]:
    """What would only restate a statement, as identifier words."""
    verbs, way = _TELLINGS.get(type(node), ((), ()))
    if isinstance(node, ast.AnnAssign) and node.value is None:
        return set()
    at: object = node
    for step in way:
        at = (at[0] if isinstance(at, list) and len(at) == 1 else None) if step == "only" else getattr(at, step, None)
    words = identifier_words(getattr(at, "id", None) or getattr(at, "attr", None) or "") if isinstance(at, (ast.Name, ast.Attribute)) else ()
    return {(verb, *words) for verb in verbs if words}


def _code_kind(text: str) -> str | None:
    """The kind of the only statement that a comment's text is, if it is one; a colon at the end may open a block."""
    tree = _tree(text) or (_tree(text + "\n    pass") if text.endswith(":") else None)
    if tree is None or len(tree.body) != 1:
        return None
    node = tree.body[0]
    bare = isinstance(node, ast.AnnAssign) and node.value is None or isinstance(node, ast.Expr) and not isinstance(node.value, ast.Call)
    return None if bare else next((name for name, kinds in _CODE if isinstance(node, kinds)), None)


def _spans(token: tokenize.TokenInfo, widths: list[int]) -> Iterator[dict[str, int]]:
    """The places of a string's text, line by line, without its prefix and quotes; columns from 0, ends exclusive."""
    bare = token.string.lstrip("rRbBuUfF")
    quote = 3 if bare[:3] in ('"""', "'''") else 1
    (top, left), (bottom, right) = token.start, token.end
    for n in range(top, bottom + 1):
        a = left + len(token.string) - len(bare) + quote if n == top else 0
        b = right - quote if n == bottom else widths[n - 1]
        yield {"n": n, "a": a, "b": max(a, b)}


def facts(path: str | None, content: str) -> dict:
    """Docstrings, comments and strings of one file. A file that doesn't parse has no docstrings and strings; its comments survive."""
    tree, tokens, widths = _tree(content), _tokens(content), [len(x) for x in content.split("\n")]
    nodes = list(ast.walk(tree)) if tree else []
    texts = [t for t in tokens if t.type == tokenize.STRING]
    docstrings = []
    for node in nodes:
        kind = _OWNERS.get(type(node))
        head = node.body[0] if kind and node.body else None
        if not isinstance(head, ast.Expr) or not isinstance(head.value, ast.Constant) or not isinstance(head.value.value, str):
            continue
        value, names = head.value, [getattr(node, "name", "")]
        if kind == "function":
            own = node.args  # its five lists alone: a default may be a lambda with parameters of its own
            listed = [*own.posonlyargs, *own.args, *own.kwonlyargs, *filter(None, (own.vararg, own.kwarg))]
            names += [a.arg for a in listed if a.arg not in ("self", "cls")]
        own = [t for t in texts if (value.lineno, value.col_offset) <= t.start and t.end <= (value.end_lineno, value.end_col_offset)]
        by_line: dict[int, dict[str, int]] = {}
        for span in (s for t in own for s in _spans(t, widths)):
            known = by_line.setdefault(span["n"], span)
            known["b"] = max(known["b"], span["b"])
        docstrings.append({"kind": kind, "line": value.lineno, "end_line": value.end_lineno, "words": sorted({w for name in names for w in identifier_words(name)}), "spans": [by_line[n] for n in sorted(by_line)]})
    told = {(n.lineno, n.col_offset): _told(n) for n in nodes if type(n) in _TELLINGS}
    comments = []
    for t in (t for t in tokens if t.type == tokenize.COMMENT):
        (line, col), text = t.start, t.string[1:].strip()
        inline = bool(t.line[:col].strip())
        meta = line == 1 and t.string.startswith("#!") or line <= 2 and re.search(r"coding\s*[:=]\s*[-\w.]+", t.string) is not None
        about = told.get((line + 1, col))
        restates = bool(about) and not inline and identifier_words(text) in about
        comments.append({"line": line, "col": col + 1, "end": t.end[1], "text": text, "inline": inline, "meta": meta, "restates": restates, "code": None if inline else _code_kind(text)})
    long = [n for n in nodes if isinstance(n, ast.Constant) and isinstance(n.value, str) and "\n" in n.value]
    return {"path": path, "content": content, "parses": tree is not None, "docstrings": sorted(docstrings, key=lambda d: d["line"]), "comments": comments, "strings": [{"a": n.lineno, "b": n.lineno + n.value.count("\n")} for n in long]}


def parsed(docs: DataFrame) -> DataFrame:
    """The facts of Python documents (path, content)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                yield pa.RecordBatch.from_pylist([facts(p, c) for p, c in zip(some.column("path").to_pylist(), some.column("content").to_pylist())], schema=_FACTS)

    return docs.select("path", "content").mapInArrow(run, SCHEMA)


def prose() -> Column:
    """As the Markdown prose lines: each docstring, run of full-line comments and inline comment is a block of body text, cut at blank lines."""
    spans = lambda c: F.struct(c["line"].alias("n"), c["col"].alias("a"), c["end"].alias("b"))
    said = F.filter("comments", lambda c: ~c["meta"])
    runs = groups(said, lambda a, b: ~a["inline"] & ~b["inline"] & (b["line"] == a["line"] + 1))
    blocks = F.concat(F.filter(F.transform("docstrings", lambda d: d["spans"]), lambda s: F.size(s) > 0), F.transform(runs, lambda g: F.transform(g, spans)))

    def line(raw: Column, span: Column, block: Column) -> Column:
        text = F.concat(F.repeat(F.lit(" "), span["a"]), F.substring(raw, span["a"] + 1, span["b"] - span["a"]), F.repeat(F.lit(" "), F.length(raw) - span["b"]))
        return let(text, lambda t: F.struct(span["n"].alias("n"), raw.alias("raw"), t.alias("text"), (block + 1).alias("block"), is_blank(t).alias("blank")))

    def made(x: Column) -> Column:
        lines = lambda b, i: F.transform(b, lambda s: line(F.coalesce(F.get(x["raws"], s["n"] - 1), F.lit("")), s, i))
        return flat(F.transform(x["blocks"], lines))

    def row(r: Column, chunk: Column) -> Column:
        whole = F.struct(r["n"], r["raw"], r["text"], F.lit("body"), r["block"], chunk + 1, r["block"], r["block"] > 1, F.lit(False), F.lit(False))
        return whole.cast(PROSE)

    all_lines = let(F.struct(F.sort_array(blocks).alias("blocks"), F.split("content", "\n", -1).alias("raws")), made)
    parts = F.filter(groups(all_lines, lambda a, b: (a["block"] == b["block"]) & ~a["blank"] & ~b["blank"]), lambda g: ~g[0]["blank"])
    return flat(F.transform(parts, lambda g, i: F.transform(g, lambda r: row(r, i))))


def _first_of(table: tuple, text: Column) -> Column:
    """k (order), a, n (place and width) and name of the first pattern of a table that a text has."""
    found = lambda p, name: F.when(has(text, "(?iU)" + p), F.transform(first(text, "(?iU)" + p), lambda x: F.struct(x["a"].alias("a"), (x["b"] - x["a"]).alias("n"), F.lit(name).alias("name")))[0])
    mark = r"#\s*"  # all patterns begin with it, so one search tells whether any is there
    return F.when(has(text, f"(?iU){mark}(?:{'|'.join(p.removeprefix(mark) for p, _ in table)})"), F.coalesce(*(found(p, name) for p, name in table)))


def rules(chosen: set[str]) -> list[Column]:
    """C001 to C008 and M001, over the columns content, parses, docstrings, comments, strings and sentences."""
    out = []
    raw_of = lambda c: F.get(F.col("raws"), c["line"] - 1)
    source_of = lambda c: F.substring(raw_of(c), c["col"], F.length(raw_of(c)))

    def by_table(rule: str, label: str, table: tuple, quote: bool) -> Column:
        message = lambda h: quoted(label, h["name"]) if quote else F.concat(F.lit(f"{label}: "), h["name"])
        one = lambda c, h: F.when(h.isNotNull(), issue(rule, message(h), c["line"], c["col"] + h["a"], c["col"] + h["a"] + h["n"]))
        return rows(F.col("comments"), lambda c: let(let(source_of(c), lambda s: _first_of(table, s)), lambda h: one(c, h)))

    if "C001" in chosen:

        def of_docstring(d: Column) -> Column:
            text = lambda s: F.substring(F.get(F.col("raws"), s["n"] - 1), s["a"] + 1, s["b"] - s["a"])
            parts = []
            for k, (word, instead) in enumerate(L.DOCSTRING_WORDS):

                def found(hits: Column, k=k, word=word, instead=instead) -> Column:
                    s = hits[0]
                    a = s["a"] + F.length(F.split(text(s), rf"(?iU)\b{word}\b", 2)[0]) + 1
                    return F.when(F.size(hits) > 0, issue("C001", f"Overused word in docstring: '{word}'", s["n"], a, a + len(word), suggestion=instead, place=(s["n"], k)))

                hits = F.filter(d["spans"], _one(lambda s, word=word: has(text(s), rf"(?iU)\b{word}\b")))
                parts.append(let(hits, _one(found)))
            return rows(F.array(*parts), lambda x: x)

        out.append(of_each(F.col("docstrings"), of_docstring))
    if "C002" in chosen:
        out.append(by_table("C002", "Verbose comment", L.VERBOSE_COMMENTS, False))
    if "C003" in chosen:
        out.append(by_table("C003", "Chat phrase in comment", L.CHATTY_COMMENTS, True))
    if "C004" in chosen:
        out.append(by_table("C004", "Formulaic placeholder", L.PLACEHOLDERS, False))
        any_placeholder = "(?iU)" + "|".join(f"(?:{p})" for p, _ in L.PLACEHOLDERS)

        def inline(c: Column) -> Column:
            before, source = F.substring(raw_of(c), F.lit(1), c["col"] - 1), source_of(c)
            hit = F.coalesce(*(F.when(has(before, code) & has(source, todo), F.transform(first(source, todo), _one(lambda x, name=name: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(name).alias("name"))))[0]) for code, todo, name in L.INLINE_PLACEHOLDERS))
            one = lambda h: F.when(h.isNotNull() & ~has(source, any_placeholder), issue("C004", F.concat(F.lit("Formulaic placeholder: "), h["name"]), c["line"], c["col"] + h["a"], c["col"] + h["b"]))
            return let(hit, one)

        out.append(rows(F.col("comments"), inline))
        errors = F.transform("raws", lambda r, i: F.when(F.contains(r, F.lit("NotImplementedError")), F.transform(F.slice(matches(r, L.TEMPLATE_ERROR), 1, 1), lambda m: issue("C004", "Formulaic placeholder: template error", i + 1, m["a"] + 1, m["b"] + 1, place=(1_000_000, i)))).otherwise(none()))
        out.append(flat(errors))

    def of_text(rule: str, message: Column, c: Column, suggestion: str) -> Column:
        at = lambda k: issue(rule, message, c["line"], k, k + F.length(c["text"]), confidence="low", suggestion=suggestion)
        return let(c["col"] + indent(F.substring(raw_of(c), c["col"] + 1, F.length(raw_of(c)))) + 1, at)

    if "C006" in chosen:
        out.append(F.transform(F.filter("comments", lambda c: c["restates"]), lambda c: of_text("C006", quoted("Comment restates code", c["text"]), c, "Delete it or explain why the code exists")))
    if "C008" in chosen:
        out.append(F.transform(F.filter("comments", lambda c: c["code"].isNotNull()), lambda c: of_text("C008", F.concat(F.lit("Commented-out code: "), c["code"]), c, "Delete it or restore it as executable code")))
    if "C007" in chosen:

        def signature(d: Column) -> Column:
            opening = F.filter("sentences", lambda s: s["start_line"].between(d["line"], d["end_line"]))[0]

            def told(s: Column) -> Column:
                said = F.array_distinct(F.transform(F.regexp_extract_all(s["text"], F.lit(IDENTIFIER_WORD), F.lit(0)), lambda x: F.lower(x)))
                own = F.array_sort(F.filter(said, lambda x: F.array_contains(d["words"], x) | ~x.isin(*L.CONNECTIVES)))
                one = issue("C007", "Docstring opening repeats the function signature", s["start_line"], s["start_col"], s["end_col"], s["end_line"], suggestion="Describe behavior, results, or constraints")
                return F.when(own == F.array_sort(d["words"]), one)

            return let(opening, told)

        out.append(rows(F.filter("docstrings", lambda d: (d["kind"] == "function") & (F.size(d["words"]) >= 2)), signature))
    if "M001" in chosen:
        marked = lambda r, i: has(r, r"(?U)\A\s*#") & ~F.exists("strings", lambda s: (s["a"] <= i + 1) & (i + 1 <= s["b"]))
        hit = lambda r: F.coalesce(*(F.when(has(r, p), F.transform(first(r, p), _one(lambda x, name=name: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(name).alias("name"))))[0]) for p, name in L.MARKUP))
        one = lambda i, h: F.when(h.isNotNull(), issue("M001", F.concat(F.lit("Markdown in comment: "), h["name"]), i + 1, h["a"] + 1, h["b"] + 1, confidence="low"))
        out.append(rows(F.transform("raws", lambda r, i: F.when(F.contains(r, F.lit("#")) & marked(r, i), let(hit(r), lambda h: one(i, h)))), lambda x: x))
    return out


def _one(body):
    """A lambda of exactly one argument, as Spark counts them."""
    return lambda x: body(x)
