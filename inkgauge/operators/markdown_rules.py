"""Rules over Markdown's structure: headings, paragraphs, fences, lists, references and links.

They read the columns content, lines, heads, fences and example (of each line) of a document's row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions.text import count, groups, has, indent, is_blank, kept, let, matches, scan, strip, words
from inkgauge.operators import markdown as M
from inkgauge.operators.findings import issue, none, of_each, quoted, rows
from inkgauge.plans import lexicon as L


def title_case(h: Column) -> Column:
    own = words(h["title"])
    large = F.size(F.filter(own, lambda x: has(x, r"(?U)^\p{Lu}") & ~F.lower(x).isin(*L.SMALL_WORDS)))
    return F.when((F.size(own) >= 3) & (large / F.size(own) > 0.6), issue("T001", "Title case heading (consider sentence case)", h["start"], h["col"], h["end_col"]))


def heading_rules(chosen: set[str]) -> list[Column]:
    out, heads = [], F.col("heads")
    if "T001" in chosen:
        out.append(rows(heads, title_case))
    if "S028" in chosen:
        message = lambda h: F.concat(F.lit("Excessive heading depth: level "), h["level"].cast("string"), F.lit(" heading '"), h["title"], F.lit("'"))
        out.append(rows(heads, lambda h: F.when(h["level"] >= 5, issue("S028", message(h), h["start"], h["col"], h["end_col"], suggestion="Use a level-4 or shallower heading"))))
    if "M008" in chosen:

        def jump(h: Column, i: Column) -> Column:
            before, level = F.get(heads, i - 1)["level"], h["level"]
            message = F.concat(F.lit("Heading level jumps from "), before.cast("string"), F.lit(" to "), level.cast("string"))
            hint = F.concat(F.lit("Add a level-"), (before + 1).cast("string"), F.lit(" heading before this level-"), level.cast("string"), F.lit(" heading"))
            return F.when(level > before + 1, issue("M008", message, h["start"], h["col"], h["end_col"], confidence="high", suggestion=hint))

        out.append(kept(F.transform(heads, jump)))
    return out


def empty_headings() -> Column:
    """S025: a heading before a peer or ancestor with only blank lines between."""
    heads = F.col("heads")

    def one(h: Column, i: Column) -> Column:
        after, below = F.get(heads, i + 1), h["start"] + F.when(h["atx"], 0).otherwise(1)
        between = F.slice("lines", below + 1, F.greatest(after["start"] - below - 1, F.lit(0)))
        empty = (after["level"] <= h["level"]) & ~F.exists(between, lambda r: ~is_blank(r["s"]))
        return F.when(empty, issue("S025", quoted("Heading without body", h["title"]), h["start"], h["col"], h["end_col"], confidence="high", suggestion="Add content under this heading or remove it"))

    return kept(F.transform(heads, one))


def tiny_sections() -> Column:
    """S029: at least three sibling sections in a row with bodies of one to five plain words."""
    lists = lambda *w: F.array(*map(F.lit, w))

    def excluded(h: Column) -> Column:
        own = F.regexp_extract_all(F.lower(h["title"]), F.lit("[a-z]+"), F.lit(0))
        named = F.arrays_overlap(own, lists("api", "changelog", "example", "examples", "faq", "faqs", "reference"))
        for group in (("release", "notes"), ("frequently", "asked", "questions")):
            named = named | (F.size(F.array_intersect(own, lists(*group))) == len(group))
        return has(h["title"], r"(?U)\?\s*\z") | named

    def step(state: Column, x: Column) -> Column:  # ancestors are the earlier headings of lower levels that none between has closed
        above = F.filter(state, lambda a: a["level"] < x["level"])
        own = F.struct(x["level"].alias("level"), x["excluded"].alias("excluded"))
        return let(above, lambda up: F.struct(F.concat(up, F.array(own)).alias("state"), (x["excluded"] | F.exists(up, lambda a: a["excluded"])).alias("out")))

    structured = r"(?mU)^(?: {4}\S|\t\S|\s*(?:[-*+>]\s+|\d+[.)]\s+|.*\|.*|```|~~~|<[!/A-Za-z]))"
    linked = r"(?mU)https?://|!?\[[^\]]+\](?:\([^)]+\)|\[[^\]]*\])|^\s*\[[^\]]+\]:\s*\S+"

    def told(h: Column, barred: Column) -> Column:
        own = F.slice("lines", h["start"] + 1, h["end_line"] - h["start"])
        joined = lambda ls: F.array_join(F.transform(ls, lambda r: r["raw"]), "\n")

        def tiny(x: Column) -> Column:
            plain = ~has(x["raw"], r"(?U)\n\s*\n") & ~has(x["raw"], structured) & ~F.contains(x["raw"], F.lit("`")) & ~has(x["raw"], linked)
            return (h["level"] > 1) & ~barred & (x["body"] != "") & (count(x["body"], r"(?U)[\w'-]+") <= 5) & plain

        text = F.struct(joined(own).alias("raw"), strip(joined(F.filter(own, lambda r: ~r["code"]))).alias("body"))
        return F.struct(*(h[c].alias(c) for c in ("start", "level", "col", "end_col")), let(text, tiny).alias("tiny"))

    def run(heads: Column) -> Column:
        stack = scan(F.transform(heads, lambda h: F.struct(h["level"].alias("level"), excluded(h).alias("excluded"))), F.expr("cast(array() as array<struct<level:int,excluded:boolean>>)"), step, "boolean")
        return let(stack, lambda barred: F.transform(heads, lambda h, i: told(h, F.get(barred, i))))

    def one(g: Column) -> Column:
        f = g[0]
        message = F.concat(F.lit("Tiny-section run: "), F.size(g).cast("string"), F.lit(" consecutive level-"), f["level"].cast("string"), F.lit(" sections"))
        return F.when(f["tiny"] & (F.size(g) >= 3), issue("S029", message, f["start"], f["col"], f["end_col"], confidence="low", suggestion="Merge related sections or expand their content"))

    return F.when(F.size("heads") >= 3, rows(groups(run(F.col("heads")), lambda a, b: a["tiny"] & b["tiny"] & (a["level"] == b["level"])), one)).otherwise(none())


def bold_overuse(threshold: int) -> Column:
    def one(p: Column) -> Column:
        message = lambda n: F.concat(F.lit("Bold overuse: "), n.cast("string"), F.lit(" bold phrases in paragraph"))
        return let(count(p["text"], r"\*\*[^*]+\*\*"), lambda n: F.when(n > threshold, issue("T002", message(n), p["start"], 1)))

    return F.when(F.contains("content", F.lit("**")), rows(M.paragraphs(F.col("lines")), one)).otherwise(none())


def label_lists(threshold: int) -> Column:
    """S004: bold labels at the head of consecutive list items; lines of code and HTML don't count."""
    open_ = F.filter("lines", lambda r: ~r["code"] & ~r["html"])
    labels = kept(F.transform(open_, lambda r, k: F.when(F.contains(r["raw"], F.lit("**")) & has(strip(r["raw"]), r"(?U)^[-*]\s+\*\*[^*]+\*\*:\s+"), F.struct(r["n"].alias("n"), k.alias("k")))))
    message = lambda g: F.concat(F.lit("Inline header list pattern ("), F.size(g).cast("string"), F.lit(" items)"))
    return rows(groups(labels, lambda a, b: b["k"] == a["k"] + 1), lambda g: F.when(F.size(g) >= threshold, issue("S004", message(g), g[0]["n"], 1)))


def unclosed_fences() -> Column:
    def one(f: Column) -> Column:
        hint = F.concat(F.lit("Add a matching '"), f["fence"], F.lit("' closing fence"))
        return F.when(~f["closed"], issue("M007", quoted("Unclosed code fence", f["fence"]), f["a"], f["col"], f["col"] + F.length(f["fence"]), confidence="high", suggestion=hint))

    return rows(F.col("fences"), one)


def repeated_paragraphs() -> Column:
    """S016: a raw paragraph of eight or more words that stood before, or that restates one after a conclusion's phrase."""
    conclusion = r"(?iU)^(?:in conclusion|to sum up|as we've seen|as we have seen|in closing)\b\s*[,;:—-]?\s*"
    filled = F.filter(F.transform("lines", lambda r: F.struct(r["n"].alias("n"), r["raw"].alias("raw"))), lambda r: ~is_blank(r["raw"]))

    def paragraph(g: Column) -> Column:
        own, last = words(F.lower(F.array_join(F.transform(g, lambda r: r["raw"]), " "))), F.element_at(g, -1)
        end = F.length(F.regexp_replace(last["raw"], r"(?U)\s+\z", "")) + 1
        whole = lambda w: F.when(F.size(w) >= 8, F.struct(g[0]["n"].alias("start"), (indent(g[0]["raw"]) + 1).alias("col"), last["n"].alias("last"), end.alias("end_col"), F.array_join(w, " ").alias("key")))
        return let(own, whole)

    def hashed(ps: Column) -> Column:
        """Paragraphs with the hashes of their texts and of what stands after a conclusion's phrase."""
        rest = lambda p: F.when(has(p["key"], conclusion), F.regexp_replace(p["key"], conclusion, ""))
        return F.transform(ps, lambda p: let(rest(p), lambda r: p.withField("hash", F.xxhash64(p["key"])).withField("rest", r).withField("rest_hash", F.when(r.isNotNull(), F.xxhash64(r)))))

    def of_all(ps: Column) -> Column:
        def first(hashes: Column, hash_: Column, key: Column) -> Column:
            return let(F.get(ps, (F.array_position(hashes, hash_) - 1).cast("int")), lambda p: F.when(p["key"] == key, p["start"]))

        def one(p: Column, hashes: Column) -> Column:
            def told(x: Column) -> Column:
                restated = F.coalesce((x["same"] == p["start"]) & (x["said"] < p["start"]), F.lit(False))
                lead = F.when(restated, F.lit("Repeated conclusion (first seen at line ")).otherwise(F.lit("Duplicate paragraph (first seen at line "))
                line = F.when(restated, x["said"]).otherwise(x["same"])
                return F.when((x["same"] < p["start"]) | restated, issue("S016", F.concat(lead, line.cast("string"), F.lit(")")), p["start"], p["col"], p["end_col"], p["last"]))

            return let(F.struct(first(hashes, p["hash"], p["key"]).alias("same"), first(hashes, p["rest_hash"], p["rest"]).alias("said")), told)

        return let(F.transform(ps, lambda p: p["hash"]), lambda hashes: rows(ps, lambda p: one(p, hashes)))

    return let(let(kept(F.transform(groups(filled, lambda a, b: b["n"] == a["n"] + 1), paragraph)), hashed), of_all)


def reference_rules(chosen: set[str]) -> Column:
    """M003, M004 (destinations), M005, M010."""

    def of_links(x: Column) -> Column:
        out, found, defs = [], x["links"], x["defs"]
        if "M003" in chosen:
            tracked = lambda l: F.transform(matches(l["url"], L.UTM), lambda m: issue("M003", quoted("Tracking parameter", m["t"]), l["n"], F.coalesce(l["url_start"], l["col"]) + m["a"], F.coalesce(l["url_start"], l["col"]) + m["b"]))
            out.append(of_each(F.filter(found, lambda l: has(l["url"], L.UTM)), tracked))
        if "M004" in chosen:
            span = lambda n, a, b, to: F.struct(n.alias("n"), a.alias("a"), b.alias("b"), to.alias("to"))
            spans = F.concat(F.transform(F.filter(found, lambda l: l["url_start"].isNotNull()), lambda l: span(l["n"], l["url_start"], l["url_end"], l["url"])), F.transform(defs, lambda d: span(d["n"], d["dest_start"], d["dest_end"], d["destination"])))

            def placeholder(p: Column) -> Column:
                def judged(to: Column) -> Column:
                    sure = F.when(F.lower(to).isin(*L.PLACEHOLDER_DESTINATIONS), "high").when(to.isin("", "#"), "low")
                    one = issue("M004", quoted("Placeholder link destination", F.when(to == "", "(empty)").otherwise(to)), p["n"], p["a"], p["b"], confidence=sure, suggestion="Replace the placeholder with a real destination")
                    return F.when(sure.isNotNull() & ~F.get("example", p["n"] - 1), one)

                return let(strip(p["to"]), judged)

            out.append(rows(F.array_distinct(spans), placeholder))
        if "M010" in chosen:

            def weak(l: Column) -> Column:
                raw = F.get("lines", l["n"] - 1)["raw"]
                at = lambda a, k: F.substring(raw, a, F.lit(k))
                shown = (at(l["col"], 1) == "[") & ~((l["col"] > 1) & (at(l["col"] - 1, 2) == "!["))
                defined = F.exists(defs, lambda d: (d["n"] == l["n"]) & (d["dest_start"] == l["url_start"]) & (d["dest_end"] == l["url_end"]))
                one = issue("M010", quoted("Non-descriptive link text", l["text"]), l["n"], l["col"] + 1, l["col"] + 1 + F.length(l["text"]), confidence="high", suggestion="Replace with text that describes the destination")
                return F.when(F.lower(F.array_join(words(l["text"]), " ")).isin(*L.WEAK_LABELS) & shown & ~F.coalesce(defined, F.lit(False)) & ~F.get("example", l["n"] - 1), one)

            out.append(rows(found, weak))
        return F.concat(*out)

    def of_uses(x: Column) -> Column:
        out, defs, used = [], x["defs"], x["used"]
        if "M005" in chosen:
            labels = F.transform(defs, lambda d: d["label"])
            hint = lambda u: F.concat(F.lit("Define '["), u["label"], F.lit("]: destination' or use an inline link"))
            lost = lambda u, known: F.when(~F.array_contains(known, u["label"]), issue("M005", quoted("Undefined reference label", u["label"]), u["n"], u["col"], u["end_col"], confidence="high", suggestion=hint(u)))
            out.append(let(labels, lambda known: rows(used, lambda u: lost(u, known))))
            one_of = lambda d: F.concat(F.lit("Use one destination for reference label '"), d["label"], F.lit("'"))
            several = lambda d: F.exists(defs, lambda o: (o["label"] == d["label"]) & (o["destination"] != d["destination"]))
            out.append(rows(defs, lambda d: F.when(several(d), issue("M005", quoted("Conflicting reference definition", d["label"]), d["n"], d["col"], d["end_col"], confidence="low", suggestion=one_of(d)))))
        if chosen & {"M003", "M004", "M010"}:
            out.append(let(F.struct(M.links(F.col("lines"), defs, used).alias("links"), defs.alias("defs")), of_links))
        return F.concat(*out)

    with_uses = lambda defs: let(F.struct(defs.alias("defs"), M.uses(F.col("lines"), defs).alias("used")), of_uses)
    return F.when(F.contains("content", F.lit("[")) | F.contains("content", F.lit("<http")), let(M.definitions(F.col("lines")), with_uses)).otherwise(none())
