"""Secret scans in DataFrame expressions: fixed patterns, and a battery of randomness tests on long tokens.

Base kinds: assign, access, hex. The battery takes every token of 20 or more characters of [A-Za-z0-9+/_=-], infers its
encoding (hex, base32, base36, base62, base64) and tests the hypothesis that its symbols are drawn uniformly from that alphabet:

- chi-squared over 4 to 16 equal bins (at least 5 symbols expected in each), by the Wilson-Hilferty transform;
- runs above and below the alphabet's middle (Wald-Wolfowitz);
- serial correlation of neighbouring symbols.

A token none of whose tests rejects (Bonferroni, RANDOM_LEVEL) may be random. The statistics of the same tests are then
weighed against ordinary text, with the token's length: each gives the ratio of its density under the encoding to that under
text, whose characters change class (lower, upper, digit, other) at rate TEXT_CHANGES, whose symbols are uneven by TEXT_EFFECT
(so the chi-squared grows with the length) and whose neighbours are correlated by up to TEXT_SERIAL. Their product is an
e-value of the hypothesis "ordinary text": its mean is at most 1 there, and it grows with the length of a random token.
Discoveries are those of the e-BH procedure over all tokens of the scan at FALSE_DISCOVERIES, which holds under any dependence:
one pass counts the e-values in bins of BIN, from which the driver reads the threshold; the second pass takes the tokens above.

Defined cases: a null or empty text has no spans; a null doc_id and repeated rows are kept; an empty table gives no rows;
overlapping spans of different base kinds all stay, a random token that overlaps a base span isn't reported again; without
any token there is no discovery.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions import text as T
from inkgauge.functions.text import let
from inkgauge.llm import common

# The patterns of the base kinds. For hex and access the least length is part of the pattern (a run that is too
# short has no later match inside it); for assign a short match must be found first and then dropped.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: name, pattern, alphabet in order of value, rate at which random neighbours change class.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 2 * 10 * 6 / 16**2),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 2 * 26 * 6 / 32**2),
    ("base36", "^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 2 * 10 * 26 / 36**2),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 1 - (2 * 26**2 + 10**2) / 62**2),
    ("base64", "^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 1 - (2 * 26**2 + 10**2 + 4) / 64**2),
)
RANDOM_LEVEL, FALSE_DISCOVERIES = 0.003, 0.01
TEXT_CHANGES, TEXT_EFFECT, TEXT_SERIAL = 0.08, 0.5, 0.2
#: Width of a bin of ln(e), and the largest one told apart from infinity.
BIN, LARGEST = 0.25, 200.0

_SPANS = "array<struct<a:long,k:int,b:long,s:string>>"


def matches(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """All leftmost matches of pattern as spans in code points; with group, those whose group has least characters."""
    found = T.matches(text, pattern)
    if group:
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["t"], pattern, group)) >= least)
    return F.transform(found, lambda x: F.struct(x["a"].cast("long").alias("a"), F.lit(kind).alias("k"), x["b"].cast("long").alias("b"), x["t"].alias("s")))


def _above(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic form (error below 2e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def battery(values: Column, k: float) -> Column:
    """struct(accepted, ratio) of values (an array of doubles) as uniform draws from 0..k-1: whether no test rejects that, and the log density ratio of chi-squared and serial correlation against text."""
    n = F.size(values).cast("double")
    m = F.greatest(F.lit(4.0), F.least(F.lit(16.0), F.floor(n / 5).cast("double")))
    edge = lambda b: F.ceil(b * k / m).cast("double")
    counts = F.transform(F.sequence(F.lit(0), (m - 1).cast("int")), lambda b: F.struct(F.size(F.filter(values, lambda v: F.floor(v * m / k) == b)).cast("double").alias("o"), (n * (edge(b + 1) - edge(b)) / k).alias("e")))
    chi = _sum(F.transform(counts, lambda c: (c["o"] - c["e"]) * (c["o"] - c["e"]) / c["e"]))
    high = F.transform(values, lambda v: (2 * v >= k).cast("double"))
    changes = _sum(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high)), lambda a, b: F.abs(a - b)))
    centre, power = (k - 1) / 2, (k * k - 1) / 12
    lagged = _sum(F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: (a - centre) * (b - centre)))
    stats = F.struct(n.alias("n"), m.alias("m"), chi.alias("chi"), _sum(high).alias("n1"), changes.alias("changes"), (lagged / (power * F.sqrt(n - 1))).alias("serial"))

    def judged(x: Column) -> Column:
        n, df = x["n"], x["m"] - 1
        nine = 2 / (9 * df)
        p_chi = _above((F.pow(x["chi"] / df, F.lit(1 / 3)) - (1 - nine)) / F.sqrt(nine))
        mean = 2 * x["n1"] * (n - x["n1"]) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * _above(F.abs((x["changes"] + 1 - mean) / F.sqrt(spread)))).otherwise(0.0)
        p_serial = 2 * _above(F.abs(x["serial"]))
        shift = n * TEXT_EFFECT
        wide = 2 * df + 4 * shift
        of_chi = 0.5 * F.log(wide / (2 * df)) - (x["chi"] - df) * (x["chi"] - df) / (4 * df) + (x["chi"] - df - shift) * (x["chi"] - df - shift) / (2 * wide)
        loose = 1 + (n - 1) * TEXT_SERIAL**2
        of_serial = 0.5 * F.log(loose) - 0.5 * x["serial"] * x["serial"] * (1 - 1 / loose)
        return F.struct((3 * F.least(p_chi, p_runs, p_serial) >= RANDOM_LEVEL).alias("accepted"), (of_chi + of_serial).alias("ratio"))

    return let(stats, judged)


def assess_token(s: Column) -> Column:
    """struct(random, e, p) of one token: whether the battery accepts it, the logarithm of its e-value against ordinary text, and the p-value min(1, 1 / e)."""
    body = F.regexp_replace(s, "=+$", "")
    chars = F.split(body, "")
    kinds = F.transform(chars, lambda c: F.when(F.rlike(c, F.lit("[a-z]")), 0).when(F.rlike(c, F.lit("[A-Z]")), 1).when(F.rlike(c, F.lit("[0-9]")), 2).otherwise(3))
    changes = _sum(let(kinds, lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t)), lambda a, b: (a != b).cast("double"))))

    def weighed(changes: Column, source: Column, alphabet: str, rate: float) -> Column:
        values = F.transform(F.split(source, ""), lambda c: (F.call_function("locate", c, F.lit(alphabet)) - 1).cast("double"))
        n = F.length(body) - 1
        runs = changes * math.log(rate / TEXT_CHANGES) + (n - changes) * math.log((1 - rate) / (1 - TEXT_CHANGES))
        judged = let(values, lambda v: battery(v, float(len(alphabet))))
        return let(judged, lambda x: F.struct(x["accepted"].alias("random"), F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), runs + x["ratio"])).alias("e")))

    def verdict_of(changes: Column) -> Column:
        verdict = F.struct(F.lit(False).alias("random"), F.lit(-LARGEST).alias("e"))
        for name, pattern, alphabet, rate in reversed(ENCODINGS):
            source = F.lower(body) if name in ("hex", "base36") else F.translate(body, "-_", "+/")
            verdict = F.when(F.rlike(s, F.lit(pattern)) & (F.length(body) >= 20), weighed(changes, source, alphabet, rate)).otherwise(verdict)
        return verdict

    return let(let(changes, verdict_of), lambda v: F.struct(v["random"].alias("random"), v["e"].alias("e"), F.least(F.lit(1.0), F.exp(-v["e"])).alias("p")))


def _tokens(text: Column) -> Column:
    """The random-looking candidates of a text, with ln(e); a token that the battery rejects has -LARGEST."""
    return F.transform(matches(text, TOKEN, 3), lambda t: let(assess_token(t["s"]), lambda v: F.struct(t.alias("t"), F.when(v["random"], v["e"]).otherwise(-LARGEST).alias("e"))))


def threshold(docs: DataFrame) -> float:
    """The least ln(e) of a discovery among all tokens of docs (text), by e-BH: the k largest are discoveries where the k-th is at least n / (k * FALSE_DISCOVERIES)."""
    text = F.coalesce("text", F.lit(""))
    bins = docs.where(F.rlike(text, F.lit(TOKEN))).select(F.explode(_tokens(text)).alias("x")).groupBy(F.floor(F.col("x.e") / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    counted = sorted(((r["bin"], r["n"]) for r in bins.collect()), reverse=True)  # 2 * LARGEST / BIN bins at most
    total, above, best = sum(n for _, n in counted), 0, math.inf
    for at, n in counted:
        above += n
        if at * BIN >= math.log(total / (above * FALSE_DISCOVERIES)):  # all of the bin are at least at * BIN
            best = at * BIN
    return best


def with_spans(df: DataFrame, least: float | None = None) -> DataFrame:
    """df with base and spans of its column text: arrays of spans (a, k, b, s), k the kind's place in KINDS, in code points, end exclusive, by start and kind.

    least: the threshold of ln(e); of all of df unless given.
    """
    least = threshold(df) if least is None else least
    text = F.coalesce("text", F.lit(""))
    base = F.sort_array(F.concat(matches(text, ASSIGN, 0, 2, 8), matches(text, ACCESS, 1), matches(text, HEX, 2)))
    found = F.transform(F.filter(_tokens(text), lambda x: x["e"] >= (least if least < math.inf else 2 * LARGEST)), lambda x: x["t"])
    none = F.expr(f"cast(array() as {_SPANS})")
    rows = df.withColumns({"base": base, "found": F.when(F.rlike(text, F.lit(TOKEN)), found).otherwise(none)})
    own = F.filter("found", lambda t: ~F.exists("base", lambda x: (x["a"] < t["b"]) & (t["a"] < x["b"])))
    return rows.withColumn("spans", F.sort_array(F.concat("base", own))).drop("found")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans of every document."""
    return with_spans(common.columns(docs, doc_id="long", text="string"))


def without_secrets(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of text replaced by mark; n_chars, where there is one, follows. Columns named base or spans are not lost."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    spanned = with_spans(held).withColumn("text", redact(F.col("text"), F.col("spans"), mark))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return spanned.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"], x["b"])), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with every span replaced by mark; spans that touch or overlap as one."""
    ranges = T.merged(F.transform(spans, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    return F.when(F.size(spans) > 0, let(ranges, lambda r: T.replaced(text, r, mark))).otherwise(text)


def sql() -> str:
    """The base kinds in DuckDB's SQL: a match's place is the length of all pieces and matches before it."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = f"""({names})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = ((0, "assign", assign, f"len(regexp_extract(m, '{assign}', 2)) >= 8"), (1, "access", "AKIA[A-Z0-9]+", "len(m) >= 16"), (2, "hex", "[0-9a-f]+", "len(m) >= 32"))
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, '{name}' AS kind, m, a FROM (SELECT rid, unnest(ms) AS m, unnest([list_sum([len(x) for x in ps[1:i]]) + coalesce(list_sum([len(x) for x in ms[1:i - 1]]), 0) for i in range(1, len(ms) + 1)]) AS a "
        f"FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{some}'))) WHERE {kept}"
        for (k, name, pattern, kept), some in zip(kinds, (f"({names})", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}"))
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + len(m) AS BIGINT), ',' ORDER BY a, k) AS listed FROM found GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256
FROM d LEFT JOIN each USING (rid)"""
