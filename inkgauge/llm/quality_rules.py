"""Line-first cleaning in DataFrame expressions: no shuffle, no Python.

Each line is judged by its punctuation, navigation and boilerplate; failing lines are removed, and a document that loses more
than half of its words with them is rejected. Counts over a whole document are arrays inside its own row, so a document costs
n log n in its length and nothing is gathered across rows.

Defined cases: a null or empty text has no words and is rejected by the base rule; lines without a word are kept as they are
and never judged; a null doc_id and repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.functions.text import let
from inkgauge.llm import common

# Fixed values.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use", "subscribe to our newsletter",
    "sign up for", "log in to", "click here", "read more", "share this", "enable javascript", "skip to content", "back to top", "lorem ipsum", "powered by",
)
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
LINE_END = r"[.!?:;…。！？][\"'”’)\]»]*[\x20\x09-\x0D]*$"
SHOUT = r"[!?]{2,}"
SEPARATOR = r"[|›»•·]"
MIN_WORDS = 50


def words_of(text: Column) -> Column:
    inner = F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(common.TOKEN_CLASS))


def windows_of(words: Column) -> Column:
    """Hashes of the 3-word windows."""
    return let(words, lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))


def repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more. A text whose windows are all different is done after one hash set; else the
    windows are sorted, equal neighbours marked, and what they cover is measured."""
    pairs = F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    twice = let(
        F.sort_array(pairs),
        lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda p: p.isNotNull())),
    )
    covered = let(twice, lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column, lower: Column, n_words: Column, n_separators: Column) -> Column:
    """Whether a line with a word fails: no end of a sentence, shouting, symbols, navigation or boilerplate."""
    return (
        ~F.rlike(line, F.lit(LINE_END))
        | (10 * F.regexp_count(line, F.lit(SHOUT)) > 3 * n_words)
        | (10 * F.regexp_count(line, F.lit(SYMBOL)) > F.length(line))
        | ((n_separators >= 2) & (4 * n_separators >= n_words))
        | F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(lower, p))
    )


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_lost_words, n_failed_lines and clean_text (without the failing lines)."""
    rows = common.columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    # the expressions stay shallow, and arrays meet by arrays_zip: a column that is read in a lambda might be computed anew for each item
    rows = rows.withColumns({"line": F.split("text", "\n", -1), "word": words_of(F.col("text"))})
    rows = rows.withColumns({"n": F.transform("line", n_words_of), "seps": F.transform("line", lambda x: F.regexp_count(x, F.lit(SEPARATOR))), "low": F.transform("line", common.ascii_lower), "windows": windows_of(F.col("word"))})
    each = F.arrays_zip("line", "n", "seps", "low")
    rows = rows.withColumn("judged", F.transform(each, lambda z: F.struct(z["line"].alias("line"), z["n"].alias("n"), ((z["n"] > 0) & line_fails(z["line"], z["low"], z["n"], z["seps"])).alias("fails"))))
    rows = rows.withColumns({"spoken": F.transform(F.filter("judged", lambda z: z["n"] > 0), lambda z: z["line"]), "lost": F.filter("judged", lambda z: z["fails"])})
    total = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, z: a + z["n"])
    counted = rows.select(
        "doc_id",
        total("judged").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        total("lost").alias("n_lost_words"),
        F.size("lost").cast("long").alias("n_failed_lines"),
        F.array_join(F.transform(F.filter("judged", lambda z: ~z["fails"]), lambda z: z["line"]), "\n").alias("clean_text"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (2 * F.col("n_lost_words") <= F.col("n_words")))


def sql() -> str:
    """The same in DuckDB's SQL over documents, without clean_text; symbols and lines are counted by other means."""
    boilerplate = " OR ".join(f"contains(translate(line, '{common.UPPER}', '{common.LOWER}'), '{p}')" for p in BOILERPLATE)
    end = LINE_END.replace("'", "''").replace(r"\x09-\x0D", r"\t-\r")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\t-\r]+') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) AS t(k) GROUP BY rid),
l AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\t-\r]+')) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
j AS (SELECT *, NOT regexp_matches(line, '{end}') OR 10 * len(regexp_extract_all(line, '{SHOUT}')) > 3 * n OR 10 * len(regexp_extract_all(line, '{SYMBOL}')) > length(line)
  OR (len(regexp_extract_all(line, '{SEPARATOR}')) >= 2 AND 4 * len(regexp_extract_all(line, '{SEPARATOR}')) >= n) OR {boilerplate} AS fails FROM l WHERE n > 0),
k AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0) AS n_lost_words, count(*) FILTER (fails) AS n_failed_lines FROM j GROUP BY rid),
a AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words, coalesce(n_failed_lines, 0) AS n_failed_lines
  FROM w LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lost_words AS BIGINT) AS n_lost_words, CAST(n_failed_lines AS BIGINT) AS n_failed_lines, base_failed,
  NOT base_failed AND 2 * n_lost_words <= n_words AS kept FROM b"""
