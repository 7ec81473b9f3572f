"""Markdown structure inside a document's own row: lines with their roles, headings, prose, paragraphs, references and links.

Everything here is an array of one row, so nothing is shuffled or gathered and documents of one path stay apart. What depends on
earlier lines is a linear fold over the lines that matter; neighbours are read by index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions.text import blocks, flags, flat, groups, has, indent, is_blank, kept, let, mask, mask_front, matches, piece, scan, strip, words

# Patterns of Markdown's marks and the block-level HTML tags.
QUOTE = r"(?U)^(?:\s{0,3}>\s?)+"
FENCE_OPEN = r"(?U)^( {0,3})(`{3,}|~{3,})\s*([\w+-]+)?\s*$"
FENCE_CLOSE = r"(?U)^ {0,3}(`+|~+)\s*$"
SETEXT = r"(?U)^ {0,3}(=+|-+)\s*$"
ATX = r"(?Ud)^ {0,3}(#{1,6})\s+(.+?)\s*$"
LIST = r"(?U)^\s*(?:[-*+]|\d+[.)])\s+"
HTML_TAGS = (
    "div", "section", "article", "aside", "nav", "header", "footer", "table", "thead", "tbody", "tr", "td", "th", "pre", "code", "script", "style", "textarea", "details", "summary", "figure", "figcaption",
)
TAG_OPEN, TAG_CLOSE = r"(?U)^\s*<([a-zA-Z][\w:-]*)\b[^>]*>\s*$", r"(?U)^\s*</([a-zA-Z][\w.:-]*)>\s*$"
COMMENT_OPEN, COMMENT_CLOSE = r"(?U)^\s*<!--", r"(?U)-->\s*$"
MDX_SINGLE = r"""(?Ud)^\s*import\s+.+\s+from\s+["'][^"']+["'];?\s*$|^\s*export\s+(?:default|const|let|var|function|class|\{)(?:\b|(?<=\{)(?=\w))|^\s*<[A-Z][\w.:]*\b[^>]*/>\s*$"""
MDX_OPEN = r"(?U)^\s*<([A-Z][\w.:]*)\b[^>]*>\s*$"
EXAMPLE = r"(?iU)\b(example|template|bad|detected|demo|before)\b"
INLINE_CODE = r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)"
#: Link text, then a destination with up to two nested levels of parentheses.
LINK_DESTINATION = r"(?s)\[[^\]]+\]\((?:\\.|[^()\\]|\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\))*\)"
AUTOLINK = r"(?U)(?<=<)https?://[^>\s]+(?=>)"


#: What a text must hold for any of its lines to be more than plain prose or a blank line; and what a prose line must hold for more than plain text.
MARKS = r"(?mU)[`\[<>#|~]|^\s*(?:[-+*=]|\d+[.)]|import\s|export\s)"
LINE_MARKS = r"(?U)[`\[<#|]|^\s*(?:[-*+]|\d+[.)])\s"


def _with_end(rows: Column, wanted) -> Column:
    """The rows that matter and, last, one without text at the document's last line, which ends what is open."""
    end = F.struct(F.size(rows).alias("n"), F.lit(None).cast("string").alias("raw"), F.lit(0).alias("q"), F.lit(None).cast("string").alias("s"), F.lit(False).alias("code"))
    return F.concat(F.filter(rows, wanted), F.array(end))


def _fences(rows: Column) -> Column:
    """Fenced blocks in order: a, b (lines), closed, fence, col."""
    mark = "^ {0,3}(`{3,}|~{3,})"

    def step(state: Column, x: Column) -> Column:
        fence = F.regexp_extract(x["s"], FENCE_OPEN, 2)
        run = F.regexp_extract(F.when(state["quoted"], x["s"]).otherwise(x["raw"]), FENCE_CLOSE, 1)
        closes = (run != "") & (F.substring(run, 1, 1) == F.substring(state["fence"], 1, 1)) & (F.length(run) >= F.length(state["fence"]))
        ends = state["open"] & (x["raw"].isNull() | closes)
        starts = ~state["open"] & (F.coalesce(fence, F.lit("")) != "")
        done = F.struct(state["a"].alias("a"), x["n"].alias("b"), x["raw"].isNotNull().alias("closed"), state["fence"].alias("fence"), state["col"].alias("col"))
        col = x["q"] + F.length(F.regexp_extract(x["s"], FENCE_OPEN, 1)) + 1
        opened = F.struct(F.lit(True).alias("open"), x["n"].alias("a"), (x["q"] > 0).alias("quoted"), fence.alias("fence"), col.alias("col"))
        shut = F.struct(F.lit(False).alias("open"), F.lit(0).alias("a"), F.lit(False).alias("quoted"), F.lit("").alias("fence"), F.lit(0).alias("col"))
        return F.struct(F.when(ends, shut).when(starts, opened).otherwise(state).alias("state"), F.when(ends, done).alias("out"))

    zero = F.expr("named_struct('open', false, 'a', 0, 'quoted', false, 'fence', '', 'col', 0)")
    marked = lambda x: (F.contains(x["raw"], F.lit("```")) | F.contains(x["raw"], F.lit("~~~"))) & (has(x["s"], mark) | has(x["raw"], mark))
    return kept(scan(_with_end(rows, marked), zero, step, "struct<a:int,b:int,closed:boolean,fence:string,col:int>"))


def _tagged(rows: Column, comments: bool) -> Column:
    """Intervals of HTML blocks (with comments) or of MDX blocks."""

    def state_of(tag: Column, a: Column) -> Column:
        return F.struct(tag.alias("tag"), a.alias("a"))

    def step(state: Column, x: Column) -> Column:
        raw, idle = x["raw"], state_of(F.lit(""), F.lit(0))
        close = F.regexp_extract(raw, TAG_CLOSE, 1)
        name = F.coalesce(F.regexp_extract(raw, TAG_OPEN if comments else MDX_OPEN, 1), F.lit(""))
        ends = F.when(state["tag"] == "!", has(raw, COMMENT_CLOSE)).otherwise(close == state["tag"]) if comments else close == state["tag"]
        inside = state["tag"] != ""
        if comments:
            known, comment = F.lower(name).isin(*HTML_TAGS), has(raw, COMMENT_OPEN)
            alone = (comment & has(raw, COMMENT_CLOSE)) | (~comment & known & has(raw, r"(?U)/>\s*$"))
            opened = F.when(comment, "!").when(known, F.lower(name))
        else:
            alone, opened = has(raw, MDX_SINGLE), F.when(name != "", name)
        alone, ends, opened = F.coalesce(alone, F.lit(False)), F.coalesce(ends, F.lit(False)) | raw.isNull(), F.coalesce(opened, F.lit(""))
        after = F.when(inside, F.when(ends, idle).otherwise(state)).when(alone | (opened == ""), state).otherwise(state_of(opened, x["n"]))
        out = F.when(inside & ends, F.struct(state["a"].alias("a"), x["n"].alias("b"))).when(~inside & alone, F.struct(x["n"].alias("a"), x["n"].alias("b")))
        return F.struct(after.alias("state"), out.alias("out"))

    if comments:
        wanted = lambda x: ~x["code"] & (F.contains(x["raw"], F.lit("<")) | F.contains(x["raw"], F.lit("-->"))) & (has(x["raw"], COMMENT_OPEN) | has(x["raw"], COMMENT_CLOSE) | has(x["raw"], TAG_OPEN) | has(x["raw"], TAG_CLOSE))
    else:
        wanted = lambda x: (F.contains(x["raw"], F.lit("<")) | F.contains(x["raw"], F.lit("port"))) & (has(x["raw"], MDX_SINGLE) | has(x["raw"], MDX_OPEN) | has(x["raw"], TAG_CLOSE))
    return kept(scan(_with_end(rows, wanted), state_of(F.lit(""), F.lit(0)), step, "struct<a:int,b:int>"))


def structure(content: Column) -> Column:
    """struct(lines, fences) of a text. A line has n, raw, q (width of the quote prefix), s (without it), code, html, front, mdx."""

    def line(x: Column, i: Column) -> Column:
        q = F.when(F.contains(x, F.lit(">")), F.length(F.regexp_extract(x, QUOTE, 0))).otherwise(0)
        return let(q, lambda q: F.struct((i + 1).alias("n"), x.alias("raw"), q.alias("q"), F.when(q == 0, x).otherwise(F.substring(x, q + 1, F.length(x))).alias("s"), F.lit(False).alias("code")))

    def blocks(rows: Column) -> Column:
        n = F.size(rows)
        delimiter = strip(rows[0]["raw"])
        front = F.when(delimiter.isin("---", "+++"), F.array_position(F.transform(F.slice(rows, F.lit(2), n), lambda r: strip(r["raw"])), delimiter)).otherwise(0)
        parts = F.struct(flags(_tagged(rows, True), n).alias("html"), flags(_tagged(rows, False), n).alias("mdx"), F.when(front > 0, front + 1).otherwise(0).alias("front"))
        return let(parts, lambda b: F.transform(rows, lambda r, i: F.struct(*(r[c].alias(c) for c in ("n", "raw", "q", "s", "code")), F.get(b["html"], i).alias("html"), (r["n"] <= b["front"]).alias("front"), F.get(b["mdx"], i).alias("mdx"))))

    def coded(rows: Column) -> Column:
        def with_code(fences: Column) -> Column:
            marked = let(flags(fences, F.size(rows)), lambda code: F.transform(rows, lambda r, i: r.withField("code", F.get(code, i))))
            return F.struct(let(marked, blocks).alias("lines"), fences.alias("fences"))

        return let(_fences(rows), with_code)

    return let(F.transform(F.split(content, "\n", -1), line), coded)


def _underlined(r: Column, after: Column) -> Column:
    """Whether a line's text is underlined by the next line."""
    return F.coalesce((F.contains(after["s"], F.lit("=")) | F.contains(after["s"], F.lit("-"))) & has(after["s"], SETEXT) & ~is_blank(r["s"]), F.lit(False))


def headings(lines: Column) -> Column:
    """start, level, title, col, end_col, end_line, atx of every heading, in order; end_line is before the next heading of any level."""

    def candidate(r: Column, after: Column) -> Column:
        atx = F.contains(r["s"], F.lit("#")) & has(r["s"], ATX)
        off = F.coalesce(after["code"] | after["html"] | after["front"], F.lit(True))
        one = lambda a: F.when(a | (~off & _underlined(r, after)), F.struct(r["n"].alias("n"), r["q"].alias("q"), r["s"].alias("s"), after["s"].alias("next_s"), a.alias("atx")))
        return F.when(~r["code"] & ~r["html"] & ~r["front"], let(atx, one))

    def step(last: Column, x: Column) -> Column:  # the underline of a kept heading is passed over
        keep = x["atx"] | (x["n"] - 1 != last)
        return F.struct(F.when(keep & ~x["atx"], x["n"]).otherwise(last).alias("state"), F.when(keep, x).alias("out"))

    def heading(x: Column) -> Column:
        s, atx = x["s"], x["atx"]
        title = F.when(atx, strip(F.regexp_replace(strip(F.regexp_extract(s, ATX, 2)), r"(?U)\s+#+\s*$", ""))).otherwise(strip(s))
        level = F.when(atx, F.length(F.regexp_extract(s, ATX, 1))).when(F.startswith(F.ltrim(x["next_s"]), F.lit("=")), 1).otherwise(2)
        left = F.when(atx, F.length(F.regexp_extract(s, r"(?U)^ {0,3}#{1,6}\s+", 0))).otherwise(indent(s))
        return let(F.struct(title.alias("t"), (x["q"] + left + 1).alias("col")), lambda y: F.struct(x["n"].alias("start"), level.alias("level"), y["t"].alias("title"), y["col"].alias("col"), (y["col"] + F.length(y["t"])).alias("end_col"), atx.alias("atx")))

    def run(rows: Column) -> Column:
        found = kept(F.transform(rows, lambda r, i: candidate(r, F.get(rows, i + 1))))
        only = kept(scan(found, F.lit(-1), step, "struct<n:int,q:int,s:string,next_s:string,atx:boolean>"))
        return let(F.transform(only, heading), lambda hs: F.transform(hs, lambda h, i: h.withField("end_line", F.coalesce(F.get(hs, i + 1)["start"] - 1, F.size(rows)))))

    return let(lines, run)


def examples(heads: Column, n: Column) -> Column:
    """Whether the nearest heading at or before each line has an example-style title."""
    return flags(F.transform(F.filter(heads, lambda h: has(h["title"], EXAMPLE)), lambda h: F.struct(h["start"].alias("a"), h["end_line"].alias("b"))), n)


def _mask_deep(text: Column) -> Column:
    """Blanks over link destinations whose parentheses nest deeper than LINK_DESTINATION reads."""

    def step(state: Column, x: Column) -> Column:
        opens, closes = x["t"] == "(", x["t"] == ")"
        link = F.startswith(x["t"], F.lit("["))
        depth = F.when(state["depth"] == 0, F.when(link, 1).otherwise(0)).when(opens | link, state["depth"] + 1).when(closes, state["depth"] - 1).otherwise(state["depth"])
        after = F.struct(depth.alias("depth"), F.when((state["depth"] == 0) & link, x["b"] - 1).otherwise(state["a"]).alias("a"))
        return F.struct(after.alias("state"), F.when((state["depth"] == 1) & closes, F.struct(state["a"].alias("a"), x["b"].alias("b"))).alias("out"))

    def blank(v: Column) -> Column:
        """What lies between the spans, which are in order and apart, and blanks for them."""
        spans = v["spans"]
        gaps = F.transform(spans, lambda x, i: F.concat(piece(v["parts"], F.coalesce(F.get(spans, i - 1)["b"], F.lit(0)), x["a"]), F.repeat(F.lit(" "), x["b"] - x["a"])))
        rest = piece(v["parts"], F.coalesce(F.element_at(spans, -1)["b"], F.lit(0)), v["n"])
        return F.when(F.size(spans) > 0, F.concat(F.array_join(gaps, ""), rest)).otherwise(F.array_join(v["parts"], ""))

    def blanked(value: Column) -> Column:
        spans = kept(scan(matches(value, r"(?s)\\[()\\]|\[[^\]]+\]\(|[()]"), F.expr("named_struct('depth', 0, 'a', 0)"), step, "struct<a:int,b:int>"))
        return let(F.struct(blocks(value).alias("parts"), spans.alias("spans"), F.length(value).alias("n")), blank)

    return let(text, lambda value: F.when(has(value, r"\]\([^()]*(?:\([^()]*){3}"), blanked(value)).otherwise(value))


def mask_inline(text: Column) -> Column:
    """Blanks over inline code, link destinations, definition URLs and autolinks."""
    text = mask(text, INLINE_CODE)
    text = mask(text, LINK_DESTINATION, lambda hit: F.substring(hit, F.lit(1), F.locate("]", hit)))
    text = _mask_deep(text)
    text = mask(text, r"(?U)^\s*\[[^\]]+\]:\s*\S+", lambda hit: F.regexp_extract(hit, r"(?U)^\s*\[[^\]]+\]:\s*", 0))
    return mask(text, AUTOLINK)


def _shown(raw: Column, q: Column, head: Column, tail: Column, marker: Column) -> Column:
    """raw with blanks over the quote prefix, a heading's marks or a list marker, and over inline marks."""
    front = F.when(q > 0, q).when(head > 0, head).otherwise(marker)
    ended = lambda t: F.when(tail > 0, F.concat(F.substring(t, F.lit(1), F.length(t) - tail), F.repeat(F.lit(" "), tail))).otherwise(t)
    inner = lambda t: F.when(has(t, r"[`\[<]"), mask_inline(t)).otherwise(t)
    return let(front, lambda k: F.when(k > 0, let(mask_front(raw, k), lambda t: let(ended(t), inner))).otherwise(inner(raw)))


PROSE = "struct<n:int,raw:string,text:string,context:string,block:int,chunk:int,scope:int,break_before:boolean,example:boolean,markdown:boolean>"


def prose(lines: Column, example: Column) -> Column:
    """Prose lines, in order: n, raw, text (masked, same width), context, block, chunk (the same here), scope (0), break_before (of the block), example, markdown."""

    def line(r: Column, under: Column, own: Column) -> Column:
        s = r["s"]
        table_row = F.contains(s, F.lit("|")) & has(strip(s), r"(?s)\A\|.*\|\z") & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2)
        skip = r["code"] | r["html"] | r["front"] | r["mdx"] | table_row
        head = F.when(F.contains(s, F.lit("#")), F.length(F.regexp_extract(s, r"^ {0,3}#{1,6}[ \t]+", 0))).otherwise(0)
        marker = F.length(F.regexp_extract(s, LIST, 0))

        def shaped(x: Column) -> Column:
            is_head = (r["q"] == 0) & ~own & (x["head"] > 0)
            trail = F.when(is_head, F.length(F.regexp_extract(s, r"[ \t]+#+[ \t]*$", 0))).otherwise(0)
            kind = F.when(r["q"] > 0, "blockquote").when(own | (x["head"] > 0), "heading").when(x["marker"] > 0, "list_item").otherwise("body")
            whole = let(kind, lambda k: F.struct(k.alias("kind"), _shown(r["raw"], r["q"], F.when(is_head, x["head"]).otherwise(0), trail, F.when(k == "list_item", x["marker"]).otherwise(0)).alias("text")))
            return let(whole, lambda y: F.struct(r["n"].alias("n"), r["raw"].alias("raw"), F.lit(False).alias("flush"), F.lit(False).alias("skip"), y["kind"].alias("kind"), F.when(~is_blank(y["text"]), y["text"]).alias("text"), x["marker"].alias("marker"), F.when(y["kind"] == "body", indent(r["raw"])).otherwise(0).alias("indent")))

        none = F.lit(None).cast("string")
        flushed = lambda k: F.struct(r["n"].alias("n"), r["raw"].alias("raw"), F.lit(True).alias("flush"), k.alias("skip"), none.alias("kind"), none.alias("text"), F.lit(0).alias("marker"), F.lit(0).alias("indent"))
        plain = lambda: F.struct(r["n"].alias("n"), r["raw"].alias("raw"), F.lit(False).alias("flush"), F.lit(False).alias("skip"), F.lit("body").alias("kind"), s.alias("text"), F.lit(0).alias("marker"), indent(s).alias("indent"))
        own_text = F.when((r["q"] > 0) | own | has(s, LINE_MARKS), let(F.struct(head.alias("head"), marker.alias("marker")), shaped)).otherwise(plain())
        return let(skip, lambda k: F.when(k | under | is_blank(s), flushed(k)).otherwise(own_text))

    told = "struct<context:string,block:int,brk:boolean>"

    def step(state: Column, x: Column) -> Column:
        # a plain line goes on with a list item while it and all lines since the item's first are indented enough
        fresh_item = state["seg"] | (x["kind"] != "body")
        of, least = F.when(fresh_item, x["kind"]).otherwise(state["of"]), F.when(fresh_item, x["marker"]).otherwise(state["least"])
        short = F.when(fresh_item, False).otherwise(state["short"]) | ((x["kind"] == "body") & (x["indent"] < least))
        context = F.when((x["kind"] == "body") & (of == "list_item") & (least > 0) & ~short, "list_item").otherwise(x["kind"])

        def line_of(c: Column) -> Column:
            fresh = x["kind"].isin("heading", "list_item") | state["seg"] | (c != state["ctx"])
            block = state["block"] + fresh.cast("int")
            brk = F.when(fresh, state["skips"]).otherwise(state["brk"])
            after = F.struct(F.lit(False).alias("seg"), F.lit(False).alias("skips"), c.alias("ctx"), of.alias("of"), least.alias("least"), short.alias("short"), block.alias("block"), brk.alias("brk"))
            out = F.struct(c.alias("context"), block.alias("block"), brk.alias("brk"))
            return F.struct(after.alias("state"), out.alias("out"))

        none = F.lit(None).cast(told)
        flushed = F.struct(state.withField("seg", F.lit(True)).withField("skips", state["skips"] | x["skip"]).alias("state"), none.alias("out"))
        return F.when(x["flush"], flushed).when(x["text"].isNull(), F.struct(state.alias("state"), none.alias("out"))).otherwise(let(context, line_of))

    def run(rows: Column) -> Column:
        setext = F.transform(rows, lambda r, i: ~r["code"] & ~F.coalesce(F.get(rows, i + 1)["code"], F.lit(True)) & _underlined(r, F.get(rows, i + 1)))
        shaped = let(setext, lambda sx: F.transform(rows, lambda r, i: line(r, F.coalesce(F.get(sx, i - 1), F.lit(False)), F.get(sx, i))))
        zero = F.expr("named_struct('seg', true, 'skips', false, 'ctx', '', 'of', '', 'least', 0, 'short', false, 'block', 0, 'brk', false)")

        def whole(x: Column, y: Column) -> Column:
            made = F.struct(x["n"], x["raw"], x["text"], y["context"], y["block"], y["block"], F.lit(0), y["brk"], F.get(example, x["n"] - 1), F.lit(True))
            return F.when(y.isNotNull(), made.cast(PROSE))

        return let(shaped, lambda xs: let(scan(xs, zero, step, told), lambda ys: kept(F.transform(xs, lambda x, i: let(F.get(ys, i), lambda y: whole(x, y))))))

    return let(lines, run)


def paragraphs(lines: Column) -> Column:
    """start, text of paragraphs: runs of lines that are no code, HTML, heading, list item or blank; quote prefixes are taken off."""

    def run(rows: Column) -> Column:
        setext = F.transform(rows, lambda r, i: ~r["code"] & ~F.coalesce(F.get(rows, i + 1)["code"], F.lit(True)) & _underlined(r, F.get(rows, i + 1)))
        cut = lambda r, i, sx: r["code"] | r["html"] | F.get(sx, i) | F.coalesce(F.get(sx, i - 1), F.lit(False)) | has(r["s"], r"(?U)^ {0,3}#{1,6}\s+") | has(r["s"], r"(?U)^\s*(?:[-*+]|\d+\.)\s+") | is_blank(r["s"])
        open_ = let(setext, lambda sx: kept(F.transform(rows, lambda r, i: F.when(~cut(r, i, sx), r))))
        return F.transform(groups(open_, lambda a, b: b["n"] == a["n"] + 1), lambda g: F.struct(g[0]["n"].alias("start"), F.array_join(F.transform(g, lambda r: r["s"]), "\n").alias("text")))

    return let(lines, run)


# --- references and links

LABEL = r"\[((?:\\.|[^\[\]\\])+)\]"
DEFINITION = r"(?U)^(\s*)\[((?:\\.|[^\[\]\\])+)\]:(\s*)(\S*)"
#: An inline link (passed over), or a reference use with an optional second label, or an image of either.
USE = r"(?<!\\)!?\[((?:\\.|[^\[\]\\])+)\](?:\([^)]*\)?|\[((?:\\.|[^\[\]\\])*)\])?"


def normal_label(label: Column) -> Column:
    """Unescaped brackets, single blanks, lower case."""
    return F.lower(F.array_join(words(F.regexp_replace(label, r"\\([\[\]])", "$1")), " "))


def _open_lines(lines: Column) -> Column:
    return F.filter(lines, lambda r: ~r["code"] & ~r["html"])


def _named(label: Column) -> Column:
    return (label != "") & ~F.startswith(label, F.lit("^"))


def definitions(lines: Column) -> Column:
    """n, label, text, destination, col, end_col, dest_start, dest_end of single-line reference definitions (footnotes aside)."""

    def one(r: Column) -> Column:
        part = lambda k: F.regexp_extract(r["s"], DEFINITION, k)
        close = r["q"] + F.length(part(1)) + F.length(part(2)) + 2
        at = close + 1 + F.length(part(3)) + 1
        return F.struct(r["n"].alias("n"), normal_label(part(2)).alias("label"), part(2).alias("text"), part(4).alias("destination"), (r["q"] + F.length(part(1)) + 1).alias("col"), (close + 1).alias("end_col"), at.alias("dest_start"), (at + F.length(part(4))).alias("dest_end"))

    return F.filter(F.transform(F.filter(_open_lines(lines), lambda r: F.contains(r["s"], F.lit("]:")) & has(r["s"], DEFINITION)), one), lambda d: _named(d["label"]))


def _masked(r: Column) -> Column:
    return mask(r["s"], INLINE_CODE)


def uses(lines: Column, defs: Column) -> Column:
    """n, label, text, col, end_col of reference uses; a lone [label] is one only where the document defines it."""
    labels, at = F.transform(defs, lambda d: d["label"]), F.transform(defs, lambda d: d["n"])

    def of_line(r: Column, known: Column) -> Column:
        def use(m: Column) -> Column:
            text, second = F.regexp_extract(m["t"], USE, 1), F.regexp_extract(m["t"], USE, 2)
            full = has(m["t"], r"\]\[[^\]]*\]\z")
            label = normal_label(F.when(full & (second != ""), second).otherwise(text))
            whole = lambda l: F.when(_named(l) & (full | F.array_contains(known, l)), F.struct(r["n"].alias("n"), l.alias("label"), text.alias("text"), (m["a"] + 1 + r["q"]).alias("col"), (m["b"] + 1 + r["q"]).alias("end_col")))
            return F.when(~has(m["t"], r"\A!?\[(?:\\.|[^\[\]\\])+\]\("), let(label, whole))

        return kept(F.transform(let(_masked(r), lambda s: matches(s, USE)), use))

    def run(x: Column) -> Column:
        wanted = F.filter(_open_lines(lines), lambda r: F.contains(r["s"], F.lit("[")) & ~F.array_contains(x["at"], r["n"]))
        return flat(F.transform(wanted, lambda r: of_line(r, x["labels"])))

    return let(F.struct(labels.alias("labels"), at.alias("at")), run)


LINKS = "array<struct<n:int,text:string,url:string,col:int,url_start:int,url_end:int>>"


def links(lines: Column, defs: Column, used: Column) -> Column:
    """n, text, url, col, url_start, url_end (null for a reference use) of inline links, reference uses, autolinks and unused definitions."""
    inline, none = r"(?s)\[([^\]]+)\]\(([^)]*)\)", F.lit(None).cast("int")

    def made(n: Column, text: Column, url: Column, col: Column, start: Column, end: Column) -> Column:
        return F.struct(n.alias("n"), text.alias("text"), url.alias("url"), col.alias("col"), start.alias("url_start"), end.alias("url_end"))

    def of_line(r: Column) -> Column:
        def both(s: Column) -> Column:
            def link(m: Column) -> Column:
                label, url, at = F.regexp_extract(m["t"], inline, 1), F.regexp_extract(m["t"], inline, 2), r["q"] + m["a"] + 1
                return made(r["n"], label, url, at, at + F.length(label) + 3, at + F.length(label) + 3 + F.length(url))

            auto = lambda m: made(r["n"], m["t"], m["t"], r["q"] + m["a"], r["q"] + m["a"] + 1, r["q"] + m["b"] + 1)
            return F.concat(F.transform(matches(s, r"\[[^\]]+\]\([^)]*\)"), link), F.transform(matches(s, AUTOLINK), auto))

        return let(_masked(r), both)

    plain = flat(F.transform(F.filter(_open_lines(lines), lambda r: F.contains(r["s"], F.lit("](")) | F.contains(r["s"], F.lit("<http"))), of_line))

    def referenced(x: Column) -> Column:
        first = F.filter(x["defs"], lambda d, i: F.array_position(x["labels"], d["label"]) == i + 1)
        names = F.transform(x["used"], lambda u: u["label"])
        of_use = lambda u: made(u["n"], u["text"], F.get(x["defs"], (F.array_position(x["labels"], u["label"]) - 1).cast("int"))["destination"], u["col"], none, none)
        met = F.transform(F.filter(x["used"], lambda u: F.array_contains(x["labels"], u["label"])), of_use)
        unused = F.transform(F.filter(first, lambda d: ~F.array_contains(names, d["label"])), lambda d: made(d["n"], d["text"], d["destination"], d["dest_start"], d["dest_start"], d["dest_end"]))
        return F.concat(met, unused)

    return F.concat(plain, let(F.struct(defs.alias("defs"), used.alias("used"), F.transform(defs, lambda d: d["label"]).alias("labels")), referenced))
