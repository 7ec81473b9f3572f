"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

1. Training frequencies of the benchmark's terms, over the whole corpus.
2. Every benchmark window is entered by its rarest term, and checked by its second rarest at the right distance.
3. The index: postings of the entry terms (position, with the words around it), stored document by document.
4. Postings meet the windows by term; lists of the second term are intersected at the offset; the longest run of equal words
   around the entry gives the phrase. A run as long as the window is a hit, and so are all its words: every window holds an
   entry of its own, so no occurrence is missed.
5. Proximity: a window is also entered by each of its two rarest different terms. Where at least NEAR_LEAST of its NEAR_TERMS
   rarest, the entry among them, stand within slack words of their places relative to the entry, it is a proximity match. So a
   window with one word swapped and up to slack inserted or left out is returned; windows of fewer than NEAR_LEAST different
   words only match as phrases.

Only the corpus' text is read at scale (twice); what is shuffled are counts and hits. Entry terms go into the scan in blocks of
at most TERMS_A_BLOCK, each over all rows, so what a task is sent has a fixed bound for any benchmark.

A document is known by its id and its text's hash, so equal rows share their hits. Sides made from the benchmark are broadcast
only if they are small in bytes (common.checked_broadcast).

Defined cases: a null or empty text has no words, hits or items; an item without words has no window; items of the same id
count once; a null item_id is the empty id; a null doc_id and repeated rows are kept; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions.text import let, merged
from inkgauge.llm import common

TERMS_A_BLOCK = 20_000
#: Proximity: rarest terms of a window that are looked for, how many must be met, and how many words off their places they may be.
NEAR_TERMS, NEAR_LEAST, SLACK = 4, 3, 3


def words_of(text: Column) -> Column:
    return common.words(common.ascii_lower(F.coalesce(text, F.lit(""))))


def _md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def entries(docs: DataFrame, benchmark: DataFrame, window: int, near: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Where windows are entered: item, term, term2 at distance gap, need (words that must be equal), left and right (the item's words around the term).

    With near, also where their proximity matches are: item, term and rare, the window's other rarest terms with their gaps.
    """
    items = common.columns(benchmark, item_id="string", text="string").select(F.coalesce("item_id", F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = common.table(items.withColumn("key", F.xxhash64("item", "w")), "decontamination-items")
    vocabulary = common.table(items.select(F.explode("w").alias("term")).distinct(), "decontamination-vocabulary")
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("term")).join(common.checked_broadcast(vocabulary), "term").groupBy("term").count()
    seen = common.table(vocabulary.join(seen, "term", "left").select("term", F.coalesce("count", F.lit(0)).alias("seen")), "decontamination-terms")
    starts = items.select("key", F.size("w").alias("n"), "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("start"))
    terms = starts.select("key", "start", F.posexplode(F.slice("w", F.col("start") + 1, window)).alias("k", "term")).withColumn("q", F.col("start") + F.col("k"))
    order = Window.partitionBy("key", "start").orderBy("seen", "q")
    ranked = terms.join(common.checked_broadcast(seen), "term").withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    pairs = ranked.groupBy("key", "start").agg(F.min_by("q", "rank").alias("q"), F.max_by("q", "rank").alias("q2")).select("key", "q", "q2").distinct()
    w, q = F.col("w"), F.col("q")
    known = common.table(
        pairs.join(items, "key").select(
            "item",
            F.get(w, q).alias("term"),
            F.get(w, F.col("q2")).alias("term2"),
            (F.col("q2") - q).alias("gap"),
            F.least(F.size(w), F.lit(window)).alias("need"),
            F.reverse(F.slice(w, F.greatest(q - window + 2, F.lit(1)), F.least(q, F.lit(window - 1)))).alias("left"),
            F.slice(w, q + 2, window - 1).alias("right"),
        ),
        "decontamination-entries",
    )
    if not near:
        return known, None
    once = terms.groupBy("key", "start", "term").agg(F.min("q").alias("q")).join(common.checked_broadcast(seen), "term")
    once = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEAR_TERMS)
    rarest = once.groupBy("key", "start").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "q"))).alias("own")).where(F.size("own") >= NEAR_LEAST)
    entered = rarest.select("key", "own", F.explode(F.slice("own", 1, 2)).alias("by"))
    others = F.transform(F.filter("own", lambda x: x["rank"] != F.col("by.rank")), lambda x: F.struct(x["term"].alias("term"), (x["q"] - F.col("by.q")).alias("gap")))
    entered = entered.select("key", F.col("by.term").alias("term"), F.sort_array(others).alias("rare")).distinct()
    return known, common.table(entered.join(items.select("key", "item"), "key").select("item", "term", "rare").distinct(), "decontamination-near")


def index(docs: DataFrame, terms: list[str], near: int, row: Column) -> DataFrame:
    """row, doc_id, md5 (of the text), n_words, and the postings of terms: term, pos, left (nearest word first) and right, near words each."""
    listed = ", ".join(f"'{t}'" for t in terms) or "''"  # terms have no punctuation, so no quotes
    found = F.expr(
        f"""transform(array(w0), w -> named_struct('n', size(w), 'at', transform(
            filter(transform(w, (x, i) -> if(x IN ({listed}), i, null)), i -> i IS NOT NULL),
            i -> named_struct('term', get(w, i), 'pos', i, 'left', reverse(slice(w, greatest(i - {near - 1}, 1), least(i, {near}))), 'right', slice(w, i + 2, {near})))))[0]"""
    )
    rows = docs.select(row.alias("row"), "doc_id", _md5(F.col("text")).alias("md5"), words_of(F.col("text")).alias("w0")).select("row", "doc_id", "md5", found.alias("x"))
    return rows.select("row", "doc_id", "md5", F.col("x.n").cast("long").alias("n_words"), F.col("x.at").alias("at"))


def _equal(a: Column, b: Column) -> Column:
    """How many words from the start are equal."""
    return let(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same)))


def _near(posting: DataFrame, own: DataFrame, slack: int) -> DataFrame:
    """row, item, a, b: proximity matches, from the first to the last of the rare terms that were met."""
    met = posting.withColumnsRenamed({"left": "dl", "right": "dr"}).join(own, "term")
    first = lambda gap: f"greatest({gap} - {slack}, 1)"
    place = lambda words, gap: f"nullif(array_position(slice({words}, {first(gap)}, greatest({gap} + {slack} + 1 - {first(gap)}, 0)), r.term), 0) + {first(gap)} - 1"
    offsets = F.expr(f"filter(transform(rare, r -> coalesce({place('dr', 'r.gap')}, -({place('dl', '-r.gap')}))), x -> x IS NOT NULL)")
    met = met.select("row", "item", "pos", offsets.alias("at")).where(F.size("at") >= NEAR_LEAST - 1)
    return met.select("row", "item", (F.col("pos") + F.least(F.array_min("at"), F.lit(0))).alias("a"), (F.col("pos") + F.greatest(F.array_max("at"), F.lit(0)) + 1).alias("b"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int | None = SLACK) -> DataFrame:
    """row, doc_id, md5, n_words, items (ids of items with an occurring window) and spans (merged word ranges, end exclusive) of every document.

    near_items and near_spans are the same of proximity matches: spans from the first to the last rare term. With slack None only phrases
    are looked for, and these two columns are not there.
    """
    docs = common.columns(docs, doc_id="long", text="string")
    known, close = entries(docs, benchmark, window, slack is not None)
    listed = known.select("term") if close is None else known.select("term").union(close.select("term"))
    listed = common.table(listed.distinct(), "decontamination-listed")
    blocks = max(1, -(-listed.count() // TERMS_A_BLOCK))
    row = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), _md5(F.col("text")))
    parts, base = [], None
    for k in range(blocks):
        here = F.pmod(F.xxhash64("term"), F.lit(blocks)) == k
        own = known.where(here)
        terms = sorted(r.term for r in listed.where(here).collect())  # at most about TERMS_A_BLOCK
        stored = common.table(index(docs, terms, window - 1 + (slack or 0), row), "decontamination-index")
        base = base if base is not None else stored.select("row", "doc_id", "md5", "n_words")
        posting = stored.select("row", F.explode("at").alias("p")).select("row", "p.*")
        met = posting.withColumnsRenamed({"left": "dl", "right": "dr"}).join(common.checked_broadcast(own), "term")
        second = F.when(F.col("gap") > 0, F.get("dr", F.col("gap") - 1)).when(F.col("gap") < 0, F.get("dl", -F.col("gap") - 1)).otherwise(F.col("term"))
        run = met.where(second == F.col("term2")).select("row", "item", "pos", "need", _equal(F.col("dl"), F.col("left")).alias("before"), _equal(F.col("dr"), F.col("right")).alias("after"))
        parts.append(run.where("before + 1 + after >= need").select("row", "item", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after") + 1).alias("b"), F.lit(False).alias("near")))
        if close is not None:
            parts.append(_near(posting, common.checked_broadcast(close.where(here)), slack).withColumn("near", F.lit(True)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    names = {"": F.lit(False)} if close is None else {"": F.lit(False), "near_": F.lit(True)}
    span = F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    each = found.groupBy("row").agg(*(x for name, near in names.items() for x in (F.sort_array(F.collect_set(F.when(F.col("near") == near, F.col("item")))).alias(f"{name}items"), F.collect_set(F.when(F.col("near") == near, span)).alias(f"{name}ranges"))))
    each = each.select("row", *(x for name in names for x in (f"{name}items", merged(f"{name}ranges").alias(f"{name}spans"))))
    empty = {"items": F.expr("array()").cast("array<string>"), "spans": F.expr("array()").cast("array<struct<a:long,b:long>>")}
    return base.join(each, "row", "left").withColumns({name + c: F.coalesce(name + c, none) for name in names for c, none in empty.items()})


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents that any window of the benchmark occurs in."""
    found = common.table(hits(docs, benchmark, window, None).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5")).distinct(), "decontamination-found")
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (_md5(docs["text"]) == found["_md5"])
    return docs.join(found, same, "left_anti")


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def sql(window: int = 10) -> str:
    """The same in DuckDB's SQL: all windows of all documents against all windows of the items, as strings."""
    lowered = f"regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {lowered} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {lowered} AS w FROM benchmark),
n AS (SELECT item, w, least(len(w), {window}) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS gram FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM n)),
kinds AS (SELECT DISTINCT k FROM win),
grams AS (SELECT rid, k, s, array_to_string(w[s:s + k - 1], ' ') AS gram FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, kinds WHERE len(w) >= k)),
hit AS (SELECT g.rid, g.s, g.k, win.item FROM grams g JOIN win ON g.k = win.k AND g.gram = win.gram),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""
