"""Rules that need one prose line, or all prose lines of a scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions import sqltext as S
from inkgauge.functions import anchors
from inkgauge.functions.anchors import ODD
from inkgauge.functions.text import CASELESS, EXACT, first, flat, groups, has, indent, kept, let, matches, strip, words
from inkgauge.operators.findings import NONE, issue, only_if, quoted, rows
from inkgauge.plans import lexicon as L



def any_of(patterns: tuple[str, ...] | list[str], flags: str = CASELESS) -> str:
    return flags + "|".join(f"(?:{p})" for p in patterns)


def escaped(phrases: list[str] | tuple[str, ...]) -> list[str]:
    return [p.replace("\\", "\\\\").replace(".", r"\.").replace("?", r"\?").replace("!", r"\!").replace("-", r"\-") for p in phrases]


def spans_to_issues(spans: Column, rule: str, label: str, order: int, after: str = "", confidence: Column | str = "medium", suggestion: Column | str | None = None) -> Column:
    return F.transform(spans, lambda x, i: issue(rule, quoted(label, x["t"], after), F.col("n"), x["a"] + 1, x["b"] + 1, confidence=confidence, suggestion=suggestion, place=(F.col("n"), order, i)))


def literal_rule(rule: str, label: str, phrases: tuple[str, ...], base: int = 0, given: str = "low") -> Column:
    """The first place of each literal phrase in the lower-cased line. Searching bytes for each phrase is much faster than one regular expression of all."""
    parts = [S.line_issues(S.literal("low", p.lower()), rule, S.lit(f"{label}: '{p}'"), k) for k, p in enumerate(phrases, base)]
    return F.expr(S.guarded(S.any_in(given, {p.lower() for p in phrases}), parts, NONE))


def _unary(body):
    """A lambda of exactly one argument, as Spark counts them."""
    return lambda x: body(x)


def first_rule(rule: str, label: str, patterns: tuple[str, ...], after: str, given: str = "low") -> Column:
    """The first match of each pattern."""
    parts = [S.guarded(S.may_match("text", given, (p,), CASELESS), [S.line_issues(S.first("text", CASELESS + p), rule, S.quoted(label, after), k)], NONE) for k, p in enumerate(patterns)]
    return F.expr(S.guarded(S.may_match("text", given, patterns, CASELESS), parts, NONE))


def all_rule(rule: str, label: str, patterns: tuple[str, ...], after: str, any_case: bool, base: int = 0, given: str = "low") -> Column:
    """All matches of each pattern."""
    flags = CASELESS if any_case else EXACT
    parts = [S.guarded(S.may_match("text", given, (p,), flags), [S.line_issues(S.matches("text", flags + p), rule, S.quoted(label, after), k)], NONE) for k, p in enumerate(patterns, base)]
    return F.expr(S.guarded(S.may_match("text", given, patterns, flags), parts, NONE))


def _map(pairs: list[tuple[str, str]]) -> str:
    return "map(" + ", ".join(f"{S.lit(a)}, {b}" for a, b in pairs) + ")"


def replacement_rule(rule: str, label: str, confidence: str, table: dict[str, str]) -> Column:
    """All places of fixed phrases outside headings, with what to write instead; by column."""
    regex = CASELESS + r"\b(?:" + "|".join(sorted(escaped(list(table)), key=len, reverse=True)) + r")\b"
    instead = f"element_at({_map([(a, S.lit(b)) for a, b in table.items()])}, lower(x.t))"
    spans = S.matches("text", regex)
    if rule == "V011":  # a decision table, model or tree is no decision
        spans = f"filter({spans}, x -> not ({instead} in ({', '.join(map(S.lit, L.DECISIONS))}) and substring(raw, x.b + 1) rlike {S.lit(L.DECISION_COMPOUND)}))"
    made = S.line_issues(spans, rule, S.quoted(label), 0, S.lit(confidence), instead, "array(n, x.a)")
    return F.expr(S.guarded(f"context <> 'heading' and {S.any_in('low', {*table, *ODD})}", [made], NONE))


def vocabulary_rule(allowed: tuple[str, ...] = (), additional: tuple[str, ...] = (), allowed_phrases: tuple[str, ...] = ()) -> Column:
    """V001: overused words, with their inflections; all places, by word and column."""
    allowed_words = {w.lower() for w in allowed}
    listed = sorted({*L.TIER1, *L.TIER2, *L.TIER3, *(w.lower() for w in additional)} - allowed_words)
    tier = {**{w: "medium" for w in listed}, **{w: "high" for w in L.TIER1}, **{w: "low" for w in L.TIER3}}
    regex_of = {w: L.INFLECTIONS.get(w, escaped([w])[0]) for w in listed}
    exact = [w for w in listed if w not in L.INFLECTIONS]
    parts = []
    if exact:  # exact words never overlap, so one search finds them all
        regex = r"(?U)\b(?:" + "|".join(sorted((regex_of[w] for w in exact), key=len, reverse=True)) + r")\b"
        hint = f"element_at({_map([(w, S.lit(L.SUGGESTIONS.get(w))) for w in exact])}, x.t)"
        sure = f"if(example, 'low', element_at({_map([(w, S.lit(tier[w])) for w in exact])}, x.t))"
        number = f"element_at({_map([(w, str(listed.index(w))) for w in exact])}, x.t)"
        message = f"concat({S.quoted('Overused word')}, coalesce(concat(' → consider \\'', {hint}, '\\''), ''))"
        parts.append(S.line_issues(S.matches("low", regex), "V001", message, 0, sure, hint, f"array(n, {number}, i)"))
    for k, word in enumerate(listed):
        if word not in exact:
            instead = L.SUGGESTIONS.get(word)
            after = f" → consider '{instead}'" if instead else ""
            parts.append(S.line_issues(S.matches("low", rf"(?U)\b(?:{regex_of[word]})\b"), "V001", S.quoted("Overused word", after), k, f"if(example, 'low', {S.lit(tier[word])})", S.lit(instead)))
    wanted = S.may_match("low", "low", tuple(regex_of.values()), "(?U)")
    for phrase in allowed_phrases:
        wanted += f" and not contains(low, {S.lit(phrase.lower())})"
    return F.expr(S.guarded(wanted, parts, NONE))


def false_ranges() -> Column:
    """S007: from X to Y with known incoherent extremes; a longer form reports the same range again."""
    pairs = "|".join(f"{a}\\s+to\\s+{b}|{b}\\s+to\\s+{a}" for a, b in L.FALSE_RANGES)
    parts = []
    for k, lead in enumerate(("", "ranging ")):
        regex, full = rf"{CASELESS}{lead}from\s+(\w+)\s+to\s+(\w+)", rf"{CASELESS}\A{lead}from\s+(?:{pairs})\z"
        parts.append(spans_to_issues(F.filter(matches(F.col("text"), regex), _unary(lambda x, full=full: has(x["t"], full))), "S007", "Vague range", k))
    return only_if(has(F.col("text"), rf"{CASELESS}from\s+\w+\s+to\s+\w+"), F.concat(*parts))


def countdown() -> Column:
    spans = first(F.col("text"), CASELESS + r"Not\s+[^.!?\n]+[.!]\s*Not\s+[^.!?\n]+[.!]\s*(?:Just|But|Only|Simply)\s+[^.!?\n]+[.!]")
    return F.transform(spans, lambda x: issue("S008", quoted("Dramatic countdown", strip(x["t"])), F.col("n"), x["a"] + 1, x["b"] + 1))


def self_answer() -> Column:
    regex = EXACT + r"([A-Z][^.!?\n]{0,60}\?)\s+([A-Z][^.!?\n]{0,50}[.!])"
    spans = F.filter(matches(F.col("text"), regex), lambda x: F.size(words(F.regexp_extract(x["t"], regex, 2))) < 8)
    return F.transform(spans, lambda x, i: issue("S009", quoted("Rhetorical self-answer", strip(x["t"])), F.col("n"), x["a"] + 1, x["b"] + 1, place=(F.col("n"), i)))


CHAIN = r"(?iUd)(?:^|,\s*)((?<!-)\b[a-z]+ing\b)[^.!?]*?(?:,\s*|\s+(?:and|while)\s+)((?<!-)\b[a-z]+ing\b)(?=\s+[a-z])(?:[^.!?]*?(?:,\s*|\s+(?:and|while)\s+)((?<!-)\b[a-z]+ing\b)(?=\s+[a-z]))?"


def participle_chain() -> Column:
    """G003: the first chain of a line, from its first participle on."""
    part = lambda k: F.regexp_extract(F.col("text"), CHAIN, k)
    said = F.array_join(F.filter(F.array(part(1), part(2), part(3)), lambda w: w != ""), ", ")
    lead = F.length(F.regexp_extract(F.regexp_extract(F.col("text"), CHAIN, 0), r"(?U)^,?\s*", 0))
    return F.transform(first(F.col("text"), CHAIN), lambda x: issue("G003", quoted("Participle chain", said), F.col("n"), x["a"] + lead + 1, x["b"] + 1))


def slide_deck() -> Column:
    """S021: a short line without a finite verb in its main clause and with two buzzwords."""
    bare = strip(F.col("text"))
    trimmed = lambda w: F.regexp_replace(F.lower(w), r"[.,;:!?'\"]+$", "")
    buzz = F.array(*map(F.lit, L.BUZZWORDS))
    own = F.transform(words(bare), trimmed)
    relative = r"(?iU)\b(?:that|which|who)\b"
    prefix = F.regexp_replace(F.split(bare, relative, 2)[0], r"(?U)\s+\z", "")
    has_prefix = has(bare, relative) & (F.length(F.split(bare, relative, 2)[0]) > 0)
    led = has(prefix, r"(?iU)^[a-z-]+ing\b") | (F.size(F.array_intersect(F.transform(words(prefix), trimmed), buzz)) >= 2)
    ends = F.array_contains(buzz, F.regexp_replace(F.lower(F.element_at(words(bare), -1)), r"^[.,;:!?'\"]+|[.,;:!?'\"]+$", ""))
    main = F.when(has_prefix & led & ends, prefix).otherwise(bare)
    finite = r"(?iU)^(?:i|we|you|he|she|it|they)(?:['’](?:m|re|s|ve|d|ll)\b|\s+(?![a-z-]+ing\b)[a-z-]+\b)|\b(?:is|are|was|were|has|have|had|do|does|did|will|shall|can|could|would|should|may|might|must)\b"
    fits = F.endswith(bare, F.lit(".")) & F.size(words(bare)).between(4, 20) & ~has(main, finite) & (F.size(F.array_intersect(own, buzz)) >= 2)
    left = indent(F.col("text"))
    return only_if(fits, F.array(issue("S021", quoted("Slide deck fragment", bare, " — consider adding a subject and verb"), F.col("n"), left + 1, left + F.length(bare) + 1, confidence="low")))


def template_residue() -> Column:
    """M006: unfinished placeholders, those of earlier patterns first; later ones that overlap are dropped. Not under example headings."""
    parts = [F.transform(matches(F.col("text"), p), _unary(lambda x, kind=kind, sure=sure: F.struct(x["t"].alias("t"), x["a"].alias("a"), x["b"].alias("b"), F.lit(kind).alias("kind"), F.lit(sure).alias("sure")))) for p, kind, sure in L.TEMPLATES]
    kind = "array<struct<t:string,a:int,b:int,kind:string,sure:string>>"
    kept = F.aggregate(F.concat(*parts), F.expr(f"cast(array() as {kind})"), lambda acc, x: F.when(F.exists(acc, lambda y: (x["a"] < y["b"]) & (y["a"] < x["b"])), acc).otherwise(F.concat(acc, F.array(x))))
    made = F.transform(kept, lambda x: issue("M006", F.concat(F.lit("Template residue ("), x["kind"], F.lit("): '"), x["t"], F.lit("'")), F.col("n"), x["a"] + 1, x["b"] + 1, confidence=x["sure"], suggestion="Replace this placeholder with final content", place=(F.col("n"), x["a"])))
    return only_if(~F.col("example") & has(F.col("text"), "|".join(f"(?:{p})" for p, _, _ in L.TEMPLATES)), made)


def demanded(chosen: frozenset[str]) -> frozenset[str] | None:
    """Lower-case literals of which each prose line with a finding of the chosen rules of lines holds one; None where that isn't known of each rule."""
    found = [{p.lower() for p in phrases} for rule, _, phrases in L.LITERALS if rule in chosen]
    found += [anchors.of_all(x[2]) for x in (*L.FIRSTS, *L.ALLS) if x[0] in chosen]
    known = {x[0] for table in (L.LITERALS, L.FIRSTS, L.ALLS) for x in table}
    return None if None in found or not chosen & _OF_LINES <= known else frozenset().union(*found, ODD)


def met(literals: frozenset[str]) -> Column:
    """Those of some literals that a document's prose lines hold: one search of all lines for each."""
    return F.expr(f"element_at(transform(array(lower(array_join(transform(prose, r -> r.text), '\\n'))), al -> filter(array({', '.join(map(S.lit, sorted(literals)))}), an -> contains(al, an))), 1)")


#: Rules of row_rules.
_OF_LINES = {x[0] for table in (L.LITERALS, L.FIRSTS, L.ALLS, L.MARKDOWN_ALLS, L.REPLACEMENTS) for x in table} | {"S007", "S008", "S009", "G003", "S021", "M006", "M004", "V001"}


def row_rules(chosen: set[str], vocabulary: dict) -> list[Column]:
    """The chosen rules as columns over prose lines (path, n, text, raw, low, context, example, markdown, and met, where what they demand is known)."""
    given = "low" if demanded(frozenset(chosen)) is None else "met"
    found: list[Column] = []
    base: dict[str, int] = {}
    for rule, label, phrases in L.LITERALS:
        if rule in chosen:
            found.append(literal_rule(rule, label, phrases, base.get(rule, 0), given))
            base[rule] = base.get(rule, 0) + len(phrases)
    found += [first_rule(*x, given=given) for x in L.FIRSTS if x[0] in chosen]
    found += [all_rule(*x, given=given) for x in L.ALLS if x[0] in chosen]
    found += [only_if(F.col("markdown"), all_rule(*x)) for x in L.MARKDOWN_ALLS if x[0] in chosen]
    found += [replacement_rule(*x) for x in L.REPLACEMENTS if x[0] in chosen]
    single = {"S007": false_ranges, "S008": countdown, "S009": self_answer, "G003": participle_chain, "S021": slide_deck}
    found += [make() for rule, make in single.items() if rule in chosen]
    if "M006" in chosen:
        found.append(only_if(F.col("markdown"), template_residue()))
    if "M004" in chosen:
        found += [only_if(F.col("markdown"), spans_to_issues(matches(F.col("text"), "(?U)" + p), "M004", "Broken reference", k)) for k, p in enumerate(L.BROKEN_MARKERS)]
    if "V001" in chosen:
        found.append(vocabulary_rule(**vocabulary))
    return found


def counted(chosen: set[str], thresholds: dict[str, int]) -> list[Column]:
    """Patterns that are reported where a scope has enough of them, and rules over all prose lines of a document; over the column prose."""
    out, prose = [], F.col("prose")
    for rule, label, patterns, name, strictly in L.COUNTED:
        if rule in chosen:
            parts = [S.line_issues(S.matches("r.text", CASELESS + p), rule, S.quoted(label), k, n="r.n") for k, p in enumerate(patterns)]
            made = S.guarded(S.may_match("r.text", "lower(r.text)", patterns, CASELESS), parts, NONE)
            hits = F.expr(f"flatten(transform(prose, r -> transform({made}, y -> named_struct('scope', r.scope, 'x', y))))")
            least = thresholds[name] + strictly
            out.append(F.transform(flat(F.filter(groups(hits, lambda a, b: a["scope"] == b["scope"]), _unary(lambda g, least=least: F.size(g) >= least))), lambda h: h["x"]))
    if "V007" in chosen:
        regex = CASELESS + r"\b(\w+)\s+(" + "|".join(L.LABEL_SUFFIXES) + r")\b"

        def labels(r: Column) -> Column:
            def label(m: Column) -> Column:
                head, tail = F.lower(F.regexp_extract(m["t"], regex, 1)), F.lower(F.regexp_extract(m["t"], regex, 2))
                possessive = (head == "s") & F.substring(r["text"], m["a"], F.lit(1)).isin("'", "’") & (m["a"] > 0)
                one = issue("V007", quoted("Invented concept label", m["t"]), r["n"], m["a"] + 1, m["b"] + 1, place=(r["n"], m["a"]))
                return F.when(~possessive & ~(head.isin(*L.LABEL_HEADS) & tail.isin("gap", "dilemma")), one)

            return kept(F.transform(matches(r["text"], regex), label))

        out.append(let(flat(F.transform(prose, labels)), lambda hits: only_if(F.size(hits) >= thresholds["invented_concept_labels"], hits)))
    if "T003" in chosen:
        dashes = F.filter(F.transform(prose, lambda r: F.struct(r["n"].alias("n"), matches(r["text"], "—|--").alias("m"))), lambda r: F.size(r["m"]) > 0)

        def overuse(hits: Column) -> Column:
            total = F.aggregate(hits, F.lit(0), lambda n, r: n + F.size(r["m"]))
            one = lambda n: only_if(n > thresholds["em_dash_overuse"], F.array(issue("T003", F.concat(F.lit("Em dash overuse: "), n.cast("string"), F.lit(" occurrences")), hits[0]["n"], hits[0]["m"][0]["a"] + 1)))
            return let(total, one)

        out.append(let(dashes, overuse))
    if "T004" in chosen:
        curly = r"[“”‘’]"

        def mixed(hits: Column) -> Column:
            a = F.length(F.split(hits[0]["text"], curly, 2)[0])
            return only_if((F.size(hits) > 0) & F.exists(prose, lambda r: has(r["text"], "[\"']")), F.array(issue("T004", "Mixed quote styles (curly and straight)", hits[0]["n"], a + 1, a + 2)))

        out.append(let(F.filter(prose, lambda r: has(r["text"], curly)), mixed))
    if "S013" in chosen:
        known = F.array(*map(F.lit, L.COMPANIES))
        named = lambda r: F.array_distinct(F.array_intersect(F.transform(words(r["text"]), lambda w: F.regexp_replace(F.lower(w), r"[.,;:!?'\"]+$", "")), known))
        lines = F.transform(prose, lambda r, i: F.struct(r["n"].alias("n"), F.when(r["markdown"], i).otherwise(r["n"]).alias("place"), named(r).alias("named")))

        def stacked(g: Column) -> Column:
            message = lambda all: F.concat(F.lit("Historical analogy stacking: "), F.size(all).cast("string"), F.lit(" companies ("), F.array_join(all, ", "), F.lit(")"))
            return let(F.array_sort(F.array_distinct(flat(F.transform(g, lambda r: r["named"])))), lambda all: F.when(F.size(all) >= thresholds["historical_analogy_stacking"], issue("S013", message(all), g[0]["n"], 1)))

        out.append(rows(groups(F.filter(lines, lambda r: F.size(r["named"]) > 0), lambda a, b: b["place"] == a["place"] + 1), stacked))
    return out
