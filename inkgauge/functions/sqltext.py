"""The same as SQL text, for rules of many patterns: one parsed expression instead of thousands of column calls."""

from __future__ import annotations

from inkgauge.functions import anchors
from inkgauge.functions.text import SLICE, SPANS


def lit(value: str | None) -> str:
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, regex: str) -> str:
    """All matches of regex in a text, as (t, a, b): one search, one split, and folds over short arrays that are joined once."""
    r, none, mark = lit(regex), f"cast(array() as {SPANS})", "'\uffff'"
    parts = f"split(regexp_replace(replace({text}, {mark}, '\ufffe'), {r}, concat({mark}, '$0', {mark})), {mark}, -1)"
    pairs = "transform(sequence(0, size(mp) div 2 - 1), mi -> named_struct('g', length(get(mp, 2 * mi)), 't', get(mp, 2 * mi + 1)))"
    own = "named_struct('t', mz.t, 'a', ms.at + mz.g, 'b', ms.at + mz.g + length(mz.t))"
    inner = f"aggregate(mc, named_struct('at', ma.at, 'out', {none}), (ms, mz) -> named_struct('at', ms.at + mz.g + length(mz.t), 'out', concat(ms.out, array({own}))))"
    runs = f"transform(sequence(0, cast((size(mq) - 1) div {SLICE} as int)), mk -> slice(mq, mk * {SLICE} + 1, {SLICE}))"
    fold = f"aggregate({runs}, named_struct('at', 0, 'out', cast(array() as array<{SPANS}>)), (ma, mc) -> element_at(transform(array({inner}), mr -> named_struct('at', mr.at, 'out', concat(ma.out, array(mr.out)))), 1), mf -> flatten(mf.out))"
    return f"if({text} rlike {r}, element_at(transform(array({parts}), mp -> element_at(transform(array({pairs}), mq -> {fold}), 1)), 1), {none})"


def first(text: str, regex: str) -> str:
    """The first match, as an array of one or none."""
    r = lit(regex)
    a, t = f"length(split({text}, {r}, 2)[0])", f"regexp_extract({text}, {r}, 0)"
    return f"if({text} rlike {r}, array(named_struct('t', {t}, 'a', {a}, 'b', {a} + length({t}))), cast(array() as {SPANS}))"


def literal(lowered: str, phrase: str) -> str:
    """The first place of a lower-case phrase."""
    p = lit(phrase)
    return f"if(contains({lowered}, {p}), array(named_struct('t', {p}, 'a', locate({p}, {lowered}) - 1, 'b', locate({p}, {lowered}) - 1 + {len(phrase)})), cast(array() as {SPANS}))"


def issue(rule: str, message: str, line: str, column: str, end_column: str = "null", end_line: str = "null", confidence: str = "'medium'", suggestion: str = "cast(null as string)", place: str = "array(0)") -> str:
    return (
        f"named_struct('rule_id', {lit(rule)}, 'message', {message}, 'line', cast({line} as int), 'column', cast({column} as int), 'end_line', cast({end_line} as int), 'end_column', cast({end_column} as int), "
        f"'confidence', {confidence}, 'suggestion', {suggestion}, 'place', {place})"
    )


def line_issues(spans: str, rule: str, message: str, order: int, confidence: str = "'medium'", suggestion: str = "cast(null as string)", place: str | None = None, n: str = "n") -> str:
    """Issues over spans x of a prose line; message may read x.t."""
    return f"transform({spans}, (x, i) -> {issue(rule, message, n, 'x.a + 1', 'x.b + 1', 'null', confidence, suggestion, place or f'array({n}, {order}, i)')})"


def quoted(label: str, after: str = "", text: str = "x.t") -> str:
    start, end = lit(label + ": '"), lit("'" + after)
    return f"concat({start}, {text}, {end})"


def _head(offset: str) -> str:
    return f"substring(text, 1, {offset})"


def line_at(offset: str) -> str:
    return f"start_line + length({_head(offset)}) - length(replace({_head(offset)}, '\\n', ''))"


def column_at(offset: str) -> str:
    tail = f"length(substring_index({_head(offset)}, '\\n', -1))"
    return f"{tail} + if({tail} = length({_head(offset)}), start_col, 1)"


def sentence_issues(spans: str, rule: str, message: str, order: int, confidence: str = "'medium'") -> str:
    """Issues over spans x of a sentence, which never cross lines."""
    return f"transform({spans}, (x, i) -> {issue(rule, message, line_at('x.a'), column_at('x.a'), column_at('x.b'), 'null', confidence, place=f'array(sent, {order})')})"


def any_in(lowered: str, literals: frozenset[str] | set[str] | tuple[str, ...]) -> str:
    """Whether a lower-cased text holds any of some literals: byte searches, for which one constant array is one expression. lowered = met: whether any is among those that were met in it."""
    if lowered == "met":
        return f"arrays_overlap(met, array({', '.join(map(lit, sorted(literals)))}))"
    found = f"exists(array({', '.join(map(lit, sorted(literals)))}), an -> contains(al, an))"
    return found.replace("contains(al,", f"contains({lowered},") if lowered.isidentifier() else f"element_at(transform(array({lowered}), al -> {found}), 1)"


def may_match(text: str, lowered: str, patterns: tuple[str, ...], flags: str) -> str:
    """False only where none of the patterns matches a text: by the literals that they demand, else by the patterns themselves."""
    demanded = anchors.of_all(patterns)
    if demanded is None:
        return f"{text} rlike {lit(flags + '|'.join(f'(?:{p})' for p in patterns))}"
    return any_in(lowered, demanded | set(anchors.ODD))


def guarded(condition: str, parts: list[str], none: str) -> str:
    return f"if({condition}, {'concat(' + ', '.join(parts) + ')' if len(parts) > 1 else parts[0]}, {none})"
