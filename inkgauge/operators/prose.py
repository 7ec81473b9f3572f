"""Chunks and sentences with exact source positions, inside a document's own row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions.text import MARK, blocks, flat, groups, has, is_blank, kept, let, piece, scan

#: End of a sentence: closing punctuation and quotes before white space, unless an abbreviation or initialism ends there. The
#: abbreviations are fixed values.
BOUNDARY = (
    r"(?iU)(?=[.!?])(?<![.!?])(?:[!?]|(?<!(?<![A-Za-z.])(?:dr|e\.g|eq|etc|fig|i\.e|jr|mr|mrs|ms|no|prof|sr|st|vs))(?<![A-Za-z]\.[A-Za-z])\.)"
    r"""[.!?]*["')\]”’]*(?=\s|\z)"""
)


#: What some rules demand of a sentence: more than so many characters or a match of a pattern (null: no such thing), or a place at either end of a chunk of so many sentences at least.
Demand = tuple[int | None, str | None, int | None]
#: Pieces of a text up to which the few that are wanted are placed one by one, each by the text before it; more are placed by one fold.
FEW = 64
#: A line and a column in one number, which a fold copies at no cost.
_LINE = 1 << 32


def _on(place: Column, part: Column) -> Column:
    """The place where a part that starts at a place ends."""
    breaks = F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))
    jumped = (F.shiftright(place, 32) + breaks) * F.lit(_LINE) + F.length(F.substring_index(part, "\n", -1)) + 1
    return F.when(F.contains(part, F.lit("\n")), jumped).otherwise(place + F.length(part))


def split_sentences(text: Column, line: Column, own: Callable[[Column], Column], offsets: bool = True, demand: Demand | None = None) -> Column:
    """Sentences of a text of lines, the first of which has that number, as own() makes them of text, a (offset, where wanted), l0 and c0 (line and 1-based column of the start), l1 and c1 (of the end).

    One search marks the boundaries, one split cuts there, one linear fold over numbers counts lines and columns. A text's U+FFFF is read as U+FFFE.
    demand: struct(n, all sentences' number, and sents, of which those that don't meet it may be left out).
    """
    line_of, column_of = (lambda p: F.shiftright(p, 32).cast("int")), (lambda p: p.bitwiseAND(F.lit(_LINE - 1)).cast("int"))

    def step(place: Column, t: Column) -> Column:
        return let(_on(place, t), lambda e: F.struct(e.alias("state"), e.alias("out")))

    def far(at: Column, t: Column) -> Column:
        return let(at + F.length(t), lambda e: F.struct(e.alias("state"), e.alias("out")))

    def wanted(x: Column, t: Column, i: Column) -> Column:
        longer, regex, ends = demand
        parts = [F.length(t) > longer] if longer is not None else []
        parts += [x["open"] & has(t, regex)] if regex is not None else []
        parts += [(F.size(x["pieces"]) >= ends) & ((i == 0) | (i >= F.size(x["pieces"]) - 2))] if ends is not None else []  # the last piece may be blank
        return reduce(lambda a, b: a | b, parts)

    def sentence(x: Column, t: Column, i: Column, at: Callable[[Column], Column]) -> Column:
        def cut(y: Column) -> Column:
            wide = F.length(y["lead"])
            rest = F.when(wide == 0, t).otherwise(F.substring(t, wide + 1, F.length(t)))
            body = F.when(i == F.size(x["pieces"]) - 1, F.regexp_replace(rest, r"(?U)\s+\z", "")).otherwise(rest)  # the others end with a mark
            start = F.when(wide == 0, y["before"]).otherwise(_on(y["before"], y["lead"]))
            return let(F.struct(body.alias("text"), start.alias("start"), wide.alias("wide")), placed)

        def placed(z: Column) -> Column:
            end = F.when(i == F.size(x["pieces"]) - 1, _on(z["start"], z["text"])).otherwise(at(i) if demand is None else _on(z["start"], z["text"]))  # others end where their piece does
            far_in = {"a": F.coalesce(F.get(x["offsets"], i - 1), F.lit(0)) + z["wide"]} if offsets else {}
            fields = {"text": z["text"], **far_in, "l0": line_of(z["start"]), "c0": column_of(z["start"])}
            whole = lambda e: own(F.struct(*(c.alias(name) for name, c in fields.items()), line_of(e).alias("l1"), column_of(e).alias("c1")))
            return F.when(z["text"] != "", let(end, whole))

        return let(F.struct(at(i - 1).alias("before"), F.regexp_extract(t, r"(?U)^\s*", 0).alias("lead")), cut)

    def placed_all(first: Column) -> Column:
        folded = lambda x: lambda i: F.coalesce(F.get(x["ends"], i), x["first"])
        joined = lambda x: lambda i: F.when(i < 0, x["first"]).otherwise(let(F.array_join(F.slice(x["pieces"], F.lit(1), i + 1), ""), lambda before: _on(x["first"], before)))

        def some(p: Column) -> Column:
            """Those that the demand wants."""
            one = lambda at: lambda x: kept(F.transform(x["pieces"], lambda t, i: F.when(wanted(x, t, i), sentence(x, t, i, at(x)))))
            whole = F.struct(p.alias("pieces"), first.alias("first"), (F.lit(False) if demand[1] is None else has(text, demand[1])).alias("open"))
            far_on = lambda x: let(F.struct(x["pieces"].alias("pieces"), x["first"].alias("first"), x["open"].alias("open"), scan(x["pieces"], first, step, "bigint").alias("ends")), one(folded))
            sents = let(whole, lambda x: F.when(F.size(x["pieces"]) <= FEW, one(joined)(x)).otherwise(far_on(x)))
            return F.struct((F.size(p) - is_blank(F.element_at(p, -1)).cast("int")).alias("n"), sents.alias("sents"))

        def run(p: Column) -> Column:
            if demand is not None:
                return some(p)
            more = [scan(p, F.lit(0), far, "int").alias("offsets")] if offsets else []
            whole = F.struct(p.alias("pieces"), scan(p, first, step, "bigint").alias("ends"), first.alias("first"), *more)
            return let(whole, lambda x: kept(F.transform(x["pieces"], lambda t, i: sentence(x, t, i, folded(x)))))

        return let(F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("\ufffe")), BOUNDARY, f"$0{MARK}"), MARK, -1), run)

    return let(line.cast("bigint") * F.lit(_LINE) + 1, placed_all)


def _sentences(c: Column, window: bool, demand: Demand | None = None) -> Column:
    """The sentences of a chunk; window: with the source of each and its neighbours, and the next one's text. Lines of a chunk follow each other."""
    first = F.get(c["lines"], F.lit(0))

    def own(x: Column) -> Column:
        return F.struct(
            c["chunk"].alias("scope"), c["context"].alias("context"), x["text"].alias("text"), x["l0"].alias("start_line"), x["c0"].alias("start_col"), x["l1"].alias("end_line"), x["c1"].alias("end_col"),
            F.when(x["l0"] == c["first_line"], first["example"]).otherwise(F.get(c["lines"], x["l0"] - c["first_line"])["example"]).alias("example"), first["markdown"].alias("markdown"),
        )

    if not window:
        return split_sentences(c["text"], c["first_line"], own, False, demand)
    found = split_sentences(c["text"], c["first_line"], lambda x: x)
    raw = F.array_join(F.transform(c["lines"], lambda x: x["raw"]), "\n")

    def joined(v: Column) -> Column:
        def with_sources(z: Column) -> Column:
            near = lambda k: F.get(z["sources"], k)
            return F.transform(z["found"], lambda x, k: F.struct(own(x).alias("s"), F.concat_ws(" ", near(k - 1), near(k), near(k + 1)).alias("window"), F.get(z["found"], k + 1)["text"].alias("next_text")))

        # where nothing is masked the sentences are their own source
        source = let(raw, lambda r: F.when(r == c["text"], F.transform(v, lambda x: x["text"])).otherwise(let(blocks(r), lambda parts: F.transform(v, lambda x: piece(parts, x["a"], x["a"] + F.length(x["text"]))))))
        whole = let(F.struct(v.alias("found"), source.alias("sources")), with_sources)
        return F.transform(whole, lambda y: y["s"].withField("window", y["window"]).withField("next_text", y["next_text"]))

    return let(found, joined)


def chunks(prose: Column, window: bool = True, demand: Demand | None = None) -> Column:
    """Runs of prose lines: chunk, context, break_before, lines, text (joined), first_line, last_line, n_sents and sents, their sentences (without window: those alone that a demand wants)."""

    def own(ls: Column) -> Column:
        first, last = F.get(ls, F.lit(0)), F.element_at(ls, -1)
        text = F.array_join(F.transform(ls, lambda x: x["text"]), "\n")
        whole = F.struct(first["chunk"].alias("chunk"), first["context"].alias("context"), first["break_before"].alias("break_before"), ls.alias("lines"), text.alias("text"), first["n"].alias("first_line"), last["n"].alias("last_line"))
        named = lambda c: [c[f].alias(f) for f in ("chunk", "context", "break_before", "lines", "text", "first_line", "last_line")]
        if demand is None:
            return let(whole, lambda c: let(_sentences(c, window), lambda s: F.struct(*named(c), F.size(s).alias("n_sents"), s.alias("sents"))))
        return let(whole, lambda c: let(_sentences(c, False, demand), lambda s: F.struct(*named(c), s["n"].alias("n_sents"), s["sents"].alias("sents"))))

    return F.transform(groups(prose, lambda a, b: a["chunk"] == b["chunk"]), own)


def sentences(parts: Column) -> Column:
    """All sentences of chunks, with sent, their order in the document."""
    return F.transform(flat(F.transform(parts, lambda c: c["sents"])), lambda s, i: s.withField("sent", i + 1))
