"""Column functions on texts: matches with code-point offsets, masks that keep the width, positions.

Regular expressions are Java's, with Unicode classes and a dot that stops at line feeds only; CASELESS adds Unicode case folding.
Offsets count code points from 0; ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

CASELESS, EXACT = "(?iUd)", "(?Ud)"
SPANS = "array<struct<t:string,a:int,b:int>>"
#: Set around matches while a text is cut: a code point that stands for no character.
MARK = "\uffff"
#: Items of one inner fold in SQL text, and of one in scan().
SLICE, SHORT = 64, 12


@contextmanager
def without_call_sites() -> Iterator[None]:
    """Column functions don't note their call sites inside: with thousands of columns that takes minutes."""
    from pyspark.errors import utils

    was = getattr(utils, "_enable_debugging_cache", None)
    utils._enable_debugging_cache = False
    try:
        yield
    finally:
        utils._enable_debugging_cache = was


_built: dict[tuple, object] = {}


def built_once(make: Callable) -> Callable:
    """Columns over named columns are built once for each application and arguments: building some thousands takes the driver seconds."""

    @wraps(make)
    def run(*args: Hashable) -> object:
        key = (SparkContext._active_spark_context.applicationId, make.__module__, make.__qualname__, args)
        if key not in _built:
            for old in [k for k in _built if k[0] != key[0]]:
                del _built[old]
            _built[key] = make(*args)
        return _built[key]

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is never inlined.

    The end of a fold over nothing copies neither the value nor what body gives; transform() copies each result, texts and arrays included.
    """
    return F.aggregate(F.expr("cast(array() as array<int>)"), value, lambda acc, x: acc, body)


def flat(items: Column) -> Column:
    """An array's arrays as one. flatten() works its type out for each row too, which a variable makes cheap."""
    return let(items, F.flatten)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"(?U)\S"))


def indent(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"(?U)^\s*", 0))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def has(text: Column, regex: str) -> Column:
    return F.rlike(text, F.lit(regex))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What step(state, item) = struct(state, out) gives for each item in order, as an array of kind.

    A fold that appends to one growing array copies it at every step, whole. Here runs of SHORT items are folded into short arrays of their
    own, runs of SHORT of those into longer ones, which are joined once. Keep what step gives small: texts are better read by index afterwards.
    """
    none = lambda depth: F.expr(f"cast(array() as {'array<' * depth}{kind}{'>' * depth})")

    def folded(value: Column, start: Column, one: Callable[[Column, Column], Column], depth: int) -> Column:
        grown = lambda acc, x: let(one(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(value, F.struct(start.alias("state"), none(depth).alias("out")), grown)

    def joined(part: Column, state: Column, one: Callable[[Column, Column], Column], depth: int) -> Column:
        return let(folded(part, state, one, depth), lambda r: F.struct(r["state"].alias("state"), (r["out"] if depth == 1 else flat(r["out"])).alias("out")))

    def whole(value: Column) -> Column:  # runs are told by number: an array of runs would be a copy of all items
        last = F.floor((F.size(value) - 1) / SHORT).cast("int")
        short = lambda state, k: joined(F.slice(value, k * SHORT + 1, F.lit(SHORT)), state, step, 1)
        long = lambda state, j: joined(F.sequence(j * SHORT, F.least(j * SHORT + SHORT - 1, last)), state, short, 2)
        return flat(folded(F.sequence(F.lit(0), F.floor(last / SHORT).cast("int")), zero, long, 2)["out"])

    return let(items, lambda value: F.when(F.size(value) > 0, whole(value)).otherwise(none(1)))


def kept(items: Column) -> Column:
    """items without nulls."""
    return F.filter(items, lambda x: x.isNotNull())


def groups(items: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """items as an array of runs: a run goes on while joined(previous, item)."""

    def run(value: Column) -> Column:
        starts = kept(F.transform(value, lambda x, i: F.when((i == 0) | ~joined(F.get(value, i - 1), x), i)))
        return let(starts, lambda at: F.transform(at, lambda a, k: F.slice(value, a + 1, F.coalesce(F.get(at, k + 1), F.size(value)) - a)))

    return let(items, run)


def flags(intervals: Column, n: Column) -> Column:
    """n booleans: which of the places 1..n lie in an interval (a, b), ends included. Intervals are in order and apart."""

    def run(v: Column) -> Column:
        parts = F.transform(v, lambda x, i: F.concat(F.array_repeat(F.lit(False), x["a"] - 1 - F.coalesce(F.get(v, i - 1)["b"], F.lit(0))), F.array_repeat(F.lit(True), x["b"] - x["a"] + 1)))
        return F.concat(flat(parts), F.array_repeat(F.lit(False), n - F.element_at(v, -1)["b"]))

    return let(intervals, lambda v: F.when(F.size(v) > 0, run(v)).otherwise(F.array_repeat(F.lit(False), n)))


def cut(text: Column, regex: str) -> Column:
    """The text as gap, match, gap, ..., gap: always an odd number of pieces. One search and one split; U+FFFF in a text is read as U+FFFE."""
    plain = F.replace(text, F.lit(MARK), F.lit("\ufffe"))
    return F.split(F.regexp_replace(plain, regex, f"{MARK}$0{MARK}"), MARK, -1)


def matches(text: Column, regex: str) -> Column:
    """All matches as (t, a, b). The regex must not match the empty string. Texts without a match cost one search."""

    def found(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.length(F.get(parts, 2 * i)).alias("gap"), F.get(parts, 2 * i + 1).alias("t")))

        def step(at: Column, x: Column) -> Column:
            a = at + x["gap"]
            return F.struct((a + F.length(x["t"])).alias("state"), F.struct(x["t"].alias("t"), a.alias("a"), (a + F.length(x["t"])).alias("b")).alias("out"))

        return scan(pairs, F.lit(0), step, "struct<t:string,a:int,b:int>")

    return F.when(has(text, regex), let(cut(text, regex), found)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def merged(ranges: Column | str) -> Column:
    """Ranges (a, b) of longs that touch or overlap as one, by start."""

    def step(upto: Column, x: Column) -> Column:
        reach = F.greatest(upto, x["b"])
        return F.struct(reach.alias("state"), F.struct(x["a"].alias("a"), reach.alias("b"), (x["a"] > upto).alias("fresh")).alias("out"))

    def joined(each: Column) -> Column:
        starts = F.filter(F.transform(each, lambda x, i: F.when(x["fresh"], i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(each, i)["a"].alias("a"), F.get(each, F.coalesce(F.get(at, k + 1), F.size(each)) - 1)["b"].alias("b"))))

    return let(scan(F.sort_array(ranges), F.lit(-1).cast("long"), step, "struct<a:long,b:long,fresh:boolean>"), joined)


#: Characters of a block.
BLOCK = 4096


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK characters, for piece(). U+FFFF in a text is read as U+FFFE."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("\ufffe")), f"(?s).{{{BLOCK}}}", f"$0{MARK}"), MARK, -1))


def piece(parts: Column, a: Column, b: Column) -> Column:
    """Characters a to b, exclusive, of a text in blocks: a place far inside costs no walk from the text's start."""
    low, high = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    part = lambda i: F.substring(F.get(parts, i), (F.greatest(a - i * BLOCK, F.lit(0)) + 1).cast("int"), (F.least(b - i * BLOCK, F.lit(BLOCK)) - F.greatest(a - i * BLOCK, F.lit(0))).cast("int"))
    return F.when(a >= b, "").when(low == high, part(low)).otherwise(F.array_join(F.transform(F.sequence(low, high), part), ""))


def replaced(text: Column, ranges: Column, mark: str) -> Column:
    """text with mark for each of its ranges (a, b), which are in order and apart."""

    def run(parts: Column, spans: Column, n: Column) -> Column:
        gaps = F.transform(spans, lambda x, i: F.concat(piece(parts, F.coalesce(F.get(spans, i - 1)["b"], F.lit(0).cast("long")), x["a"]), F.lit(mark)))
        return F.array_join(F.concat(gaps, F.array(piece(parts, F.element_at(spans, -1)["b"], n))), "")

    whole = let(F.struct(blocks(text).alias("parts"), ranges.alias("spans"), F.length(text).cast("long").alias("n")), lambda x: run(x["parts"], x["spans"], x["n"]))
    return F.when(F.size(ranges) > 0, whole).otherwise(text)


def first(text: Column, regex: str) -> Column:
    """The first match as an array of one (t, a, b), or of none."""
    one = F.struct(F.regexp_extract(text, regex, 0).alias("t"), F.length(F.split(text, regex, 2)[0]).alias("a"), (F.length(F.split(text, regex, 2)[0]) + F.length(F.regexp_extract(text, regex, 0))).alias("b"))
    return F.when(has(text, regex), F.array(one)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def literal(lowered: Column, phrase: str) -> Column:
    """The first place of a lower-case phrase in a lower-cased text, as an array of one (t, a, b) or of none."""
    at = F.locate(phrase, lowered)
    one = F.struct(F.lit(phrase).alias("t"), (at - 1).alias("a"), (at - 1 + len(phrase)).alias("b"))
    return F.when(at > 0, F.array(one)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def mask(text: Column, regex: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches become blanks of the same width; keep(match) is the beginning of a match that stays."""

    def piece(hit: Column, i: Column) -> Column:
        kept = keep(hit) if keep else F.lit("")
        return F.when(i % 2 == 0, hit).otherwise(F.concat(kept, F.repeat(F.lit(" "), F.length(hit) - F.length(kept))))

    return let(text, lambda value: F.when(has(value, regex), F.array_join(F.transform(cut(value, regex), piece), "")).otherwise(value))


def mask_front(text: Column, n: Column) -> Column:
    return F.concat(F.repeat(F.lit(" "), n), F.substring(text, n + 1, F.length(text)))


#: A match with its offsets, and the line and column where it starts and ends.
PLACE = "struct<t:string,a:int,b:int,l0:int,c0:int,l1:int,c1:int>"


def after(line: Column, column: Column, part: Column) -> Column:
    """Line l and column c where a part that starts at a line and column ends."""
    jumps = F.struct((line + F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))).alias("l"), (F.length(F.substring_index(part, "\n", -1)) + 1).alias("c"))
    return F.when(F.contains(part, F.lit("\n")), jumps).otherwise(F.struct(line.alias("l"), (column + F.length(part)).alias("c")))


def _place(t: Column, a: Column, start: Column) -> Column:
    end = lambda e: F.struct(t.alias("t"), a.alias("a"), (a + F.length(t)).alias("b"), start["l"].alias("l0"), start["c"].alias("c0"), e["l"].alias("l1"), e["c"].alias("c1"))
    return let(after(start["l"], start["c"], t), end)


def located(text: Column, regex: str, line: Column, column: Column) -> Column:
    """All matches as PLACEs of a text that starts at a line and column.

    Matches are in order, so one fold over the gaps between them counts lines and columns on; no place is looked up from the text's start.
    """

    def found(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.get(parts, 2 * i).alias("gap"), F.get(parts, 2 * i + 1).alias("t")))

        def step(state: Column, x: Column) -> Column:
            def own(start: Column) -> Column:
                return let(_place(x["t"], state["at"] + F.length(x["gap"]), start), lambda p: F.struct(F.struct(p["b"].alias("at"), p["l1"].alias("l"), p["c1"].alias("c")).alias("state"), p.alias("out")))

            return let(after(state["l"], state["c"], x["gap"]), own)

        # a single match needs no fold
        alone = let(after(line.cast("int"), column.cast("int"), F.get(parts, F.lit(0))), lambda start: F.array(_place(F.get(parts, F.lit(1)), F.length(F.get(parts, F.lit(0))), start)))
        return F.when(F.size(parts) == 3, alone).otherwise(scan(pairs, F.struct(F.lit(0).alias("at"), line.cast("int").alias("l"), column.cast("int").alias("c")), step, PLACE))

    return F.when(has(text, regex), let(cut(text, regex), found)).otherwise(F.expr(f"cast(array() as array<{PLACE}>)"))


def first_located(text: Column, regex: str, line: Column, column: Column) -> Column:
    """The first match as an array of one PLACE, or of none."""

    def found(gap: Column) -> Column:
        return F.array(let(after(line.cast("int"), column.cast("int"), gap), lambda start: _place(F.regexp_extract(text, regex, 0), F.length(gap), start)))

    return F.when(has(text, regex), let(F.get(F.split(text, regex, 2), F.lit(0)), found)).otherwise(F.expr(f"cast(array() as array<{PLACE}>)"))


def squeeze(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.array_join(words(text), " ")
