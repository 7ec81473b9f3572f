"""Rules over sentences: alone, with their neighbours, in runs, or by paragraph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions import sqltext as S
from inkgauge.functions.anchors import ODD
from inkgauge.functions.text import CASELESS, EXACT, after, blocks, count, first, first_located, groups, has, kept, let, located, matches, piece, scan, squeeze, strip, words
from inkgauge.operators.findings import NONE, issue, none, of_each, only_if, quoted, rows
from inkgauge.operators.line_rules import _unary, any_of, escaped
from inkgauge.plans import lexicon as L


#: What gives a sentence's field by name: a column of a table of sentences (F.col), or a field of a sentence in an array.
Field = Callable[[str], Column]


def main() -> Column:
    return F.col("context").isin("body", "list_item", "blockquote")


def shown() -> Column:
    return ~F.col("example")


def spans(regex: str, s: Field = F.col) -> Column:
    """All matches in a sentence with their places in the source."""
    return located(s("text"), regex, s("start_line"), s("start_col"))


def first_span(regex: str, s: Field = F.col) -> Column:
    return first_located(s("text"), regex, s("start_line"), s("start_col"))


def span_issue(rule: str, message: Column | str, x: Column, order: Column | int = 0, confidence: Column | str = "medium", suggestion: Column | str | None = None, full: bool = True, s: Field = F.col) -> Column:
    """An issue over a span of the sentence; full: with its end line."""
    return issue(rule, message, x["l0"], x["c0"], x["c1"], x["l1"] if full else None, confidence, suggestion, (s("sent"), order))


def evidence() -> Column:
    w = F.col("window")
    return has(w, L.LINK) | has(w, "(?iU)" + L.MONTH) | has(w, "(?U)" + L.NAMED_SOURCE) | F.contains(w, F.lit("%")) | (count(w, "(?U)" + L.NUMBER) >= 2)


def quantity_evidence() -> Column:
    w = F.col("window")
    return has(w, "(?U)" + L.NUMBER) | has(w, L.LINK) | has(w, "(?iU)" + L.MONTH) | has(w, "(?U)" + L.NAMED_SOURCE) | has(w, "(?iU)" + L.QUANTITY_EVIDENCE)


def _evidenced(rule: str, label: str, patterns: tuple[str, ...]) -> Column:
    parts = [S.guarded(S.may_match("text", "low", (p,), CASELESS), [S.sentence_issues(S.first("text", CASELESS + p), rule, S.quoted(label), k)], NONE) for k, p in enumerate(patterns)]
    found = F.expr(S.guarded(S.may_match("text", "low", patterns, CASELESS), parts, NONE))
    return F.when(evidence(), F.transform(found, lambda x: x.withField("confidence", F.lit("low")))).otherwise(found)


def _imprecise_quantity() -> Column:
    regex = CASELESS + L.IMPRECISE_QUANTITY
    sure = F.when(quantity_evidence(), "low").otherwise("medium")
    made = F.transform(spans(regex), lambda x, i: span_issue("V014", quoted("Imprecise quantity", squeeze(x["t"])), x, i, sure, "Use a measured quantity or cite the source"))
    return only_if((F.col("context") != "heading") & shown() & has(F.col("text"), regex), made)


def _claims(regex: str, s: Field = F.col) -> Column:
    """Matches of a verb and a claim (group 1, at the end), from the claim on, unless a hypothesis comes before in the sentence."""

    def claim(x: Column) -> Column:
        def cut_off(t: Column) -> Column:
            head = F.substring(x["t"], F.lit(1), F.length(x["t"]) - F.length(t))
            place = lambda p: F.struct(t.alias("t"), (x["b"] - F.length(t)).alias("a"), x["b"].alias("b"), p["l"].alias("l0"), p["c"].alias("c0"), x["l1"].alias("l1"), x["c1"].alias("c1"))
            return let(after(x["l0"], x["c0"], head), place)

        return let(F.regexp_extract(x["t"], regex, 1), cut_off)

    # what comes after the first hypothesis comes after one
    supposed = let(first(s("text"), r"(?iU)\b(?:if|whether)\b"), lambda h: F.get(h, F.lit(0))["b"])
    return let(supposed, lambda h: F.transform(F.filter(spans(regex, s), lambda x: h.isNull() | (x["a"] < h)), claim))


def _superlative() -> Column:
    regex = CASELESS + L.SUPERLATIVE
    compared = "(?iU)" + L.COMPARISON_SET
    open_ = (F.col("context") != "heading") & shown() & has(F.col("text"), regex) & ~has(F.col("text"), r"(?U)\?\s*\z") & ~has(F.col("text"), f"(?iU){L.LITERAL_CLAIM}|\\bthe (?:label|phrase|wording)\\b") & ~has(F.col("window"), compared) & ~quantity_evidence()
    made = F.transform(_claims(regex), lambda x, i: span_issue("V015", quoted("Unbounded superlative", squeeze(x["t"])), x, i, "low", "Name the comparison set and supporting evidence"))
    return only_if(open_, made)


def _absolute() -> Column:
    regex = CASELESS + L.ABSOLUTE
    open_ = shown() & has(F.col("text"), regex) & ~has(F.col("text"), f"(?iU){L.LITERAL_CLAIM}|\\bthe (?:phrase|wording)\\b") & ~has(F.col("window"), "(?iU)" + L.TESTED_BOUND)
    made = F.transform(spans(regex), lambda x, i: span_issue("V016", quoted("Absolute reliability claim", squeeze(x["t"])), x, i, suggestion="State the tested scope and observed result"))
    return only_if(open_, made)


def _anecdote() -> Column:
    window = F.concat_ws(" ", F.col("text"), F.col("next_text"))
    general = r"(?iU)\b(?:shows?|proves?|demonstrates?|illustrates?|every|all|broader|nationwide|generally)\b"
    parts = [F.transform(first_span(CASELESS + p), _unary(lambda x, k=k: span_issue("S017", quoted("Anecdote as evidence", x["t"]), x, k, full=False))) for k, p in enumerate(L.ANECDOTES)]
    return only_if(has(F.col("text"), any_of(L.ANECDOTES)) & ~has(F.col("text"), r"(?iU)\b(?:example|dateline|format|quoted sentence)\b") & has(window, general), F.concat(*parts))


def _euphemism() -> Column:
    parts = []
    for k, phrase in enumerate(L.EUPHEMISMS):
        made = S.sentence_issues(S.first("text", CASELESS + escaped([phrase])[0]), "S019", S.lit(f"Corporate euphemism: '{phrase}' — consider stating the action directly"), k)
        parts.append(f"if(low rlike {S.lit('(?U)' + L.ORGANIZATION)}, {made}, {NONE})" if phrase in L.AMBIGUOUS_EUPHEMISMS else made)
    return F.expr(S.guarded(S.any_in("low", {*L.EUPHEMISMS, *ODD}), parts, NONE))


def _all_spans(rule: str, label: str, regex: str, suggestion: str, confidence: str = "medium", plain: bool = False, keep=None, where: Column | None = None) -> Column:
    """All matches with full spans; plain: the text as it is, else with single blanks."""
    found = spans(regex) if keep is None else F.filter(spans(regex), keep)
    made = F.transform(found, lambda x, i: span_issue(rule, quoted(label, x["t"] if plain else squeeze(x["t"])), x, i, confidence, suggestion))
    return only_if((shown() if where is None else where) & has(F.col("text"), regex), made)


def _ellipsis() -> Column:
    regex = L.ELLIPSIS
    bare = F.regexp_replace(strip(F.col("text")), r"^['\"“”‘’`()\[\]{}]+|['\"“”‘’`()\[\]{}]+$", "")
    open_ = shown() & has(F.col("text"), regex) & ~has(F.col("text"), "(?iU)" + L.ELLIPSIS_TALK) & ~has(F.col("text"), "(?iU)" + L.LOG_LINE) & (bare != "...")
    return only_if(open_, F.transform(spans(regex), lambda x, i: span_issue("T012", "Rhetorical ellipsis: '...'", x, i, suggestion="Use direct punctuation or complete the thought")))


def _capitals() -> Column:
    regex = "(?U)" + L.CAPITALS
    cues = F.array(*map(F.lit, L.CAPS_CUES))
    keep = lambda x: F.arrays_overlap(F.regexp_extract_all(x["t"], F.lit("[A-Z]+(?:'[A-Z]+)?"), F.lit(0)), cues)
    return _all_spans("T013", "ALL-CAPS emphasis", regex, "Use normal sentence casing unless uppercase is required", "low", True, keep, F.col("context").isin("body", "list_item") & shown())


WORD = r"(?U)\b\w+(?:[-'’]\w+)*\b"


PAIR = "struct<a:int,b:int,parent:int,l0:int,c0:int,l1:int,c1:int>"


def pairs_of(text: Column, line: Column, column: Column) -> Column:
    """Balanced parentheses of a text that starts at a line and column, as PAIRs: offsets of both, that of the open one around or -1, and their places."""

    def step(open_: Column, x: Column) -> Column:
        depth = F.size(open_)
        last = F.element_at(open_, -1)
        own = F.struct(last["a"].alias("a"), x["a"].alias("b"), F.coalesce(F.get(open_, depth - 2)["a"], F.lit(-1)).alias("parent"), last["l"].alias("l0"), last["c"].alias("c0"), x["l1"].alias("l1"), x["c1"].alias("c1"))
        opened = F.struct(x["a"].alias("a"), x["l0"].alias("l"), x["c0"].alias("c"))
        then = F.when(x["t"] == "(", F.concat(open_, F.array(opened))).when(depth > 0, F.slice(open_, F.lit(1), depth - 1)).otherwise(open_)
        return F.struct(then.alias("state"), F.when((x["t"] == ")") & (depth > 0), own).alias("out"))

    return kept(scan(located(text, r"[()]", line, column), F.expr("cast(array() as array<struct<a:int,l:int,c:int>>)"), step, PAIR))


def _parentheticals() -> Column:
    def wide(parts: Column) -> Column:
        return F.filter(pairs_of(F.col("text"), F.col("start_line"), F.col("start_col")), lambda p: (p["parent"] < 0) & (count(piece(parts, p["a"] + 1, p["b"]), WORD) >= 3))

    def made(found: Column) -> Column:
        a, b = found[0], F.element_at(found, -1)
        message = F.concat(F.lit("Parenthetical overload: "), F.size(found).cast("string"), F.lit(" substantial parentheticals in one sentence"))
        one = issue("T014", message, a["l0"], a["c0"], b["c1"], b["l1"], suggestion="Rewrite the sentence or move parenthetical details into separate sentences", place=(F.col("sent"), 0))
        return only_if(F.size(found) >= 3, F.array(one))

    return only_if(main() & shown() & (count(F.col("text"), r"\(") >= 3), let(let(blocks(F.col("text")), wide), made))


def nested_parentheses() -> Column:
    """T015, over chunks: a balanced pair inside another balanced pair, which may span lines."""

    def of_chunk(c: Column) -> Column:
        def one(p: Column) -> Column:
            return issue("T015", "Nested parenthetical", p["l0"], p["c0"], p["c1"], F.when(p["l0"] != p["l1"], p["l1"]), "high", "Remove one level of parentheses or rewrite the sentence")

        def inside(upto: Column, p: Column) -> Column:  # pairs never cross, so one that begins before the furthest end so far lies in another
            return F.struct(F.greatest(upto, p["b"]).alias("state"), F.when(upto > p["a"], p).alias("out"))

        nested = kept(scan(F.sort_array(pairs_of(c["text"], c["first_line"], F.lit(1))), F.lit(-1), inside, PAIR))
        return F.transform(nested, one)

    return of_each(F.filter("chunks", lambda c: count(c["text"], r"\(") >= 2), of_chunk)


def _overloaded() -> Column:
    regex = "(?iU)" + L.CLAUSE_BOUNDARY
    n = count(F.col("text"), regex)
    message = F.concat(F.lit("Clause/coordination overload: "), n.cast("string"), F.lit(" boundaries in one sentence"))
    one = issue("G031", message, F.col("start_line"), F.col("start_col"), F.col("end_col"), F.col("end_line"), suggestion="Split the sentence or simplify its clause structure", place=(F.col("sent"),))
    return only_if(main() & shown() & (n >= 4), F.array(one))


def _long_sentence(threshold: int) -> Column:
    n = count(F.col("text"), r"(?U)\S+")
    message = F.concat(F.lit("Long sentence: "), n.cast("string"), F.lit(f" words (threshold {threshold})"))
    return only_if(main() & (n > threshold), F.array(issue("T008", message, F.col("start_line"), F.col("start_col"), F.col("end_col"), F.col("end_line"), place=(F.col("sent"),))))


def _opener(rule: str, label: str, pattern: str, suggestion: str, confidence: str, extra: Column | None = None) -> Column:
    made = F.transform(first_span(CASELESS + pattern), lambda x: span_issue(rule, quoted(label, squeeze(x["t"])), x, confidence=confidence, suggestion=suggestion))
    where = main() & shown() & has(F.col("text"), CASELESS + pattern)
    return only_if(where if extra is None else where & extra, made)


def _slash() -> Column:
    regex = r"(?<![/\w])and/or(?![/\w])"
    found = F.filter(spans(CASELESS + r"https?://\S+|" + regex), lambda x: ~F.startswith(F.lower(x["t"]), F.lit("http")))  # those inside an address are passed over with it
    made = F.transform(found, lambda x, i: span_issue("T016", quoted("Slash alternative", x["t"]), x, i, suggestion="Choose 'and', 'or', or 'both' explicitly"))
    return only_if(shown() & has(F.col("text"), CASELESS + regex), made)


def _bare_url() -> Column:
    regex = r"(?iU)\bhttps?://[^\s<>\[\]{}\"'`]+"

    def trimmed(x: Column) -> Column:
        url = F.regexp_replace(x["t"], r"[.,;:!?]+$", "")
        extra = F.greatest(count(url, r"\)") - count(url, r"\("), F.lit(0))
        tail = F.length(F.regexp_extract(url, r"\)*$", 0))
        url = F.substring(url, F.lit(1), F.length(url) - F.least(extra, tail))
        return let(url, lambda u: F.struct(u.alias("t"), x["a"].alias("a"), (x["a"] + F.length(u)).alias("b"), x["l0"].alias("l0"), x["c0"].alias("c0"), x["l0"].alias("l1"), (x["c0"] + F.length(u)).alias("c1")))

    made = F.transform(F.transform(spans(regex), trimmed), lambda x, i: span_issue("M009", quoted("Bare URL in prose", x["t"]), x, i, "high", "Use descriptive Markdown link text"))
    return only_if(F.col("markdown") & (F.col("context") == "body") & shown() & has(F.col("text"), regex) & ~has(F.col("text"), r"(?iU)\b(?:literal URL|URL (?:literal|string|value|format|syntax))\b"), made)


def demand(chosen: frozenset[str], thresholds: dict[str, int]) -> tuple[int | None, str | None, int | None] | None:
    """What the chosen rules of sentences demand of a sentence (prose.Demand), if that is known of each: more than n words are at least 2 n + 1 characters."""
    if not chosen or not chosen <= {"T008", "T010", "S022"}:
        return None
    return 2 * thresholds["sentence_length_max"] if "T008" in chosen else None, L.REPEATED_PUNCTUATION if "T010" in chosen else None, thresholds["wall_of_text_sentences"] if "S022" in chosen else None


def row_rules(chosen: set[str], thresholds: dict[str, int]) -> list[Column]:
    """The chosen rules as columns over sentences with their windows (and example, markdown)."""
    made = {rule: lambda x=x: _evidenced(*x) for x in L.EVIDENCED for rule in [x[0]]}
    made |= {x[0]: lambda x=x: _opener(*x) for x in L.OPENERS}
    made |= {x[0]: lambda x=x: _all_spans(x[0], x[1], CASELESS + x[2], x[3], where=main() & shown()) for x in L.ANYWHERE}
    there = r"^There\s+(?:is|are|was|were)\b"
    rest = F.regexp_replace(F.col("text"), CASELESS + there, "")
    made |= {
        "V014": _imprecise_quantity,
        "V015": _superlative,
        "V016": _absolute,
        "S017": _anecdote,
        "S019": _euphemism,
        "T008": lambda: _long_sentence(thresholds["sentence_length_max"]),
        "T010": lambda: _all_spans("T010", "Repeated or mixed punctuation", L.REPEATED_PUNCTUATION, "Use a single terminal punctuation mark", "high", True),
        "T012": _ellipsis,
        "T013": _capitals,
        "T014": _parentheticals,
        "T016": _slash,
        "G016": lambda: _opener("G016", "Existential opener", there, "Start with the sentence's subject", "medium", count(rest, WORD) >= 5),
        "G031": _overloaded,
        "M009": _bare_url,
    }
    return [make() for rule, make in sorted(made.items()) if rule in chosen]


def _runs(found: Column, key: Callable[[Column], Column]) -> Column:
    """Runs of sentences of a scope with equal keys; those of a null key are in none."""
    keyed = F.transform(found, lambda s: F.struct(s.alias("s"), key(s).alias("key")))
    whole = groups(keyed, lambda a, b: (a["s"]["scope"] == b["s"]["scope"]) & a["key"].eqNullSafe(b["key"]))
    return F.filter(whole, lambda g: g[0]["key"].isNotNull())


def _run_rule(runs: Column, rule: str, threshold: int, message: Callable[[Column, Column], Column]) -> Column:
    """Runs of at least threshold sentences, reported at the first one; message gets the number and the first sentence."""

    def one(g: Column) -> Column:
        first = g[0]["s"]
        return F.when(F.size(g) >= threshold, issue(rule, message(F.size(g).cast("string"), first), first["start_line"], first["start_col"]))

    return rows(runs, one)


def grouped(chosen: set[str], thresholds: dict[str, int]) -> list[Column]:
    """Rules over runs and paragraphs of a document's sentences."""
    out, found = [], F.col("sentences")
    prose = F.filter(found, lambda s: s["context"].isin("body", "blockquote"))
    told = lambda label, end: (lambda n, s: F.concat(F.lit(label), n, F.lit(end)))
    if "S010" in chosen:
        word = lambda s: F.regexp_extract(s["text"], r"(?U)^\S+", 0)
        message = lambda n, s: F.concat(F.lit("Anaphora: "), n, F.lit(" consecutive sentences starting with '"), word(s), F.lit("'"))
        out.append(_run_rule(_runs(prose, lambda s: F.lower(word(s))), "S010", thresholds["anaphora_abuse"], message))
    if "S011" in chosen:
        fragment = lambda s: F.when(has(s["text"], EXACT + r"\A[A-Z][a-z]*ing\b[^.!?]{0,60}[.!?]\z"), True)
        out.append(_run_rule(_runs(prose, fragment), "S011", thresholds["gerund_fragment_litany"], told("Gerund fragment litany: ", " consecutive gerund fragments")))
    if "S018" in chosen:
        cited = lambda s: F.when(has(s["text"], EXACT + L.CITATION), True)
        out.append(_run_rule(_runs(found, cited), "S018", thresholds["citation_name_drop"], told("Citation name-dropping: ", " consecutive 'Author (Year) verb' sentences")))
    if "S022" in chosen:
        out.append(rows(F.col("chunks"), lambda c: _wall(c["sents"], c["n_sents"], thresholds["wall_of_text_sentences"])))
    if "T006" in chosen:
        said = F.filter("chunks", lambda c: has(c["text"], CASELESS + r"\b(?:said|use|show|get)\b"))
        out.append(of_each(said, lambda c: _varied(c["sents"])))
    if "G015" in chosen:
        one = F.slice(F.filter(found, lambda s: s["markdown"] & (s["context"] == "body") & ~s["example"]), 1, 1)

        def opened(v: Column) -> Column:
            s = v.__getitem__
            parts = F.concat(*(F.transform(first_span(CASELESS + p, s), lambda x: span_issue("G015", quoted("Generic scene-setting opener", squeeze(x["t"])), x, suggestion="Replace the generic opener with the concrete subject or change", s=s)) for p in L.SCENE_OPENERS))
            return only_if(has(s("text"), any_of(L.SCENE_OPENERS)), F.slice(parts, 1, 1))

        out.append(of_each(one, opened))
    return out


def _wall(sents: Column, n: Column, least: int) -> Column:
    first, last = sents[0], F.element_at(sents, -1)
    message = F.concat(F.lit("Wall-of-text paragraph: "), n.cast("string"), F.lit(f" sentences (threshold {least})"))
    one = issue("S022", message, first["start_line"], first["start_col"], last["end_col"], last["end_line"], suggestion="Split the paragraph into shorter paragraphs")
    return F.when((n >= least) & first["context"].isin("body", "blockquote") & ~first["example"], one)


def _varied(g: Column) -> Column:
    """T006 in one paragraph's sentences: the first place of a formal synonym of a plain word that the paragraph uses too."""
    parts = []
    for k, (plain, formal) in enumerate(L.SYNONYMS):

        def found(hits: Column, k=k, plain=plain, formal=formal) -> Column:
            s = lambda name: F.lit(0) if name == "sent" else hits[0][name]
            one = lambda x: span_issue("T006", F.concat(F.lit("Elegant variation: '"), x["t"], F.lit(f"' (also uses '{plain}')")), x, s=s).withField("place", F.array(s("scope"), F.lit(k)))
            said = F.exists(g, lambda y: has(F.lower(y["text"]), rf"(?U)\b{plain}\b"))
            return only_if((F.size(hits) > 0) & said, F.transform(first_span(rf"{CASELESS}\b{formal}\b", s), one))

        parts.append(let(F.filter(g, _unary(lambda y, formal=formal: has(y["text"], rf"{CASELESS}\b{formal}\b"))), _unary(found)))
    return F.concat(*parts)


def punchy_fragments(threshold: int) -> Column:
    """T007, over chunks: consecutive body paragraphs of at most five words; other contexts and breaks end a run."""
    short = lambda c: (F.size(words(c["text"])) <= 5) & (c["context"] == "body")
    told = F.transform("chunks", lambda c: F.struct(c["first_line"].alias("line"), c["break_before"].alias("cut"), short(c).alias("short")))
    message = lambda n: F.concat(F.lit("Short punchy fragments: "), n.cast("string"), F.lit(" consecutive short paragraphs"))
    return rows(groups(told, lambda a, b: a["short"] & b["short"] & ~b["cut"]), lambda g: F.when(g[0]["short"] & (F.size(g) >= threshold), issue("T007", message(F.size(g)), g[0]["line"], 1)))


def listicles() -> Column:
    """S012: three sentences First, Second, Third; else ordinals in a paragraph; else patterns in its lines."""
    opener = r"(?iU)^(first|second|third)(?:ly)?,"

    def of_chunk(c: Column) -> Column:
        said = F.transform(c["sents"], lambda s: F.lower(F.regexp_extract(s["text"], opener, 1)))
        three = lambda o: F.filter(c["sents"], lambda s, i: (F.get(o, i) == "first") & (F.get(o, i + 1) == "second") & (F.get(o, i + 2) == "third"))

        def opening(hits: Column) -> Column:
            s = hits[0].__getitem__
            b = F.length(F.regexp_extract(s("text"), opener, 0))
            return F.array(issue("S012", "Listicle in prose: 'First... Second... Third...'", s("start_line"), s("start_col"), s("start_col") + b, s("start_line"), suggestion="Use an explicit numbered list", place=(0, s("start_line"))))

        lowered = F.lower(F.array_join(F.transform(c["lines"], lambda x: x["text"]), " "))
        all_three = lambda t: has(t, rf"(?U)\bthe {L.ORDINALS[0]}\b") & has(t, rf"(?U)\bthe {L.ORDINALS[1]}\b") & has(t, rf"(?U)\bthe {L.ORDINALS[2]}\b")
        lead = F.filter(c["lines"], lambda x: has(x["text"], r"(?iU)\bthe first\b"))
        ordinal = let(lead, lambda ls: only_if(F.size(ls) > 0, F.array(issue("S012", "Listicle in prose: 'the first... the second... the third...'", ls[0]["n"], 1, place=(1, ls[0]["n"])))))

        def lined(x: Column) -> Column:
            hit = F.slice(F.concat(*(first(x["text"], CASELESS + p) for p in L.LISTICLES)), 1, 1)
            return only_if(has(x["text"], any_of(L.LISTICLES)), F.transform(hit, lambda m: issue("S012", "Listicle in prose pattern", x["n"], m["a"] + 1, m["b"] + 1, place=(1, x["n"]))))

        rest = let(lowered, lambda t: F.when(all_three(t), ordinal).otherwise(of_each(c["lines"], lined)))
        return let(let(said, three), lambda hits: F.when(F.size(hits) > 0, opening(hits)).otherwise(rest))

    return of_each(F.filter("chunks", lambda c: c["context"].isin("body", "blockquote") & has(c["text"], r"(?iU)first|1st")), of_chunk)


def hedging() -> Column:
    """G002: hedging phrases, redundant modals and stacked hedges. What lies in a redundant modal is dropped; of findings at one place the last kind stays."""
    modal, hedge = r"(?iU)\b(may|might|could)\s+(?:possibly|potentially|perhaps)\b", r"(?iU)\b(?:may|might|potentially|arguably|possibly|perhaps)\b|(?:appears? to|suggests? that|could be(?: interpreted as)?)"

    def phrases(r: Column) -> Column:
        parts = [F.transform(matches(r["text"], CASELESS + p), _unary(lambda x, k=k: issue("G002", quoted("Hedging phrase", x["t"]), r["n"], x["a"] + 1, x["b"] + 1, place=(r["n"], k, x["a"])))) for k, p in enumerate(L.HEDGING)]
        return only_if(has(r["text"], any_of(L.HEDGING)), F.concat(*parts))

    def redundant(v: Column) -> Column:
        s = v.__getitem__
        return F.transform(spans(modal, s), lambda x, i: span_issue("G002", quoted("Redundant modal hedge", squeeze(x["t"])), x, i, "high", F.lower(F.regexp_extract(x["t"], modal, 1)), s=s))

    def stacked(v: Column) -> Column:
        message = lambda n: F.concat(F.lit("Hedge stacking: "), n.cast("string"), F.lit(" hedges in one sentence"))
        one = lambda n: F.when((n >= 2) & ~((n == 2) & has(v["text"], modal)), issue("G002", message(n), v["start_line"], v["start_col"], confidence="high", place=(v["sent"],)))
        return let(count(v["text"], hedge), one)

    def start(x: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["column"].alias("column"))

    def end(x: Column) -> Column:
        return F.struct(F.coalesce(x["end_line"], x["line"]).alias("line"), F.coalesce(x["end_column"], x["column"]).alias("column"))

    def decided(parts: Column) -> Column:
        covered = lambda x: F.exists(parts["red"], lambda r: (start(r) <= start(x)) & (end(x) <= F.struct(r["end_line"].alias("line"), r["end_column"].alias("column"))))
        kinds = [F.transform(xs, _unary(lambda x, k=k: F.struct(x["line"].alias("line"), x["column"].alias("column"), F.lit(k).alias("kind"), x["place"].alias("place"), x.alias("x")))) for k, xs in enumerate((F.filter(parts["phrases"], lambda x: ~covered(x)), F.filter(parts["stacked"], lambda x: ~covered(x)), parts["red"]))]
        whole = groups(F.sort_array(F.concat(*kinds)), lambda a, b: (a["line"] == b["line"]) & (a["column"] == b["column"]))
        return F.transform(whole, lambda g: F.element_at(g, -1)["x"].withField("place", F.array(g[0]["line"], g[0]["column"])))

    some = F.filter("sentences", lambda s: has(s["text"], hedge) | has(s["text"], modal))
    return let(let(some, lambda s: F.struct(of_each(F.col("prose"), phrases).alias("phrases"), of_each(s, redundant).alias("red"), rows(s, stacked).alias("stacked"))), decided)


def comparatives() -> Column:
    """G038: predicate comparatives without a target, measure or table in the sentence's lines and the four before."""
    regex, target, measure = CASELESS + L.COMPARATIVE, "(?iU)" + L.COMPARISON_TARGET, "(?iU)" + L.MEASUREMENT
    wanted = lambda s: s["context"].isin("body", "list_item") & ~s["example"] & has(s["text"], regex) & ~has(s["text"], r"(?U)\?\s*\z") & ~has(s["text"], f"(?iU){L.LITERAL_CLAIM}|\\bthe (?:label|phrase|wording)\\b")
    table = r"(?mUd)^\s*\|?.+\|.+\|?\s*$"

    def of_sentences(hits: Column) -> Column:
        def claims(v: Column, lines: Column) -> Column:
            s = v.__getitem__
            low = F.greatest(s("start_line") - 4, F.lit(1))
            near = F.array_join(F.slice(lines, low, F.greatest(s("end_line") - low + 1, F.lit(0))), "\n")
            made = F.transform(_claims(regex, s), lambda x, i: span_issue("G038", quoted("Undefined comparative", squeeze(x["t"])), x, i, "low", "Name the comparison target", s=s))
            return let(near, lambda t: only_if(~has(t, target) & ~has(t, measure) & ~has(t, table), made))

        split = F.split(F.col("content"), L.LINE_ENDS, -1)
        return F.when(F.size(hits) > 0, let(split, lambda lines: of_each(hits, lambda v: claims(v, lines)))).otherwise(none())

    return let(F.filter("sentences", wanted), of_sentences)
