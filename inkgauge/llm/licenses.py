"""Licence scans by a positional index of rare words.

1. Document frequencies of the words of all templates, over the whole corpus (a few hundred numbers).
2. The index holds a word's postings (template, position). Of each template, its ANCHORS words of the highest inverse document
   frequency are looked up.
3. A file is read once; its licence words are looked up from the highest inverse document frequency on. A posting at template
   position q met at file position p says that the template starts at p - q.
4. The postings of a template's words are intersected by relative position: a start stands if AGREE different words put it there,
   give or take SLACK words.
5. At each start that stands the template is laid over the file, word by word, following insertions of up to SLACK words. The
   proposal is accepted if the mandatory key phrases stand consecutively there, and if COVERAGE of the template's weight is met.

The four base phrases are templates that are key phrases as a whole and are entered by their rarest word: each of their
occurrences contains it, so all places are found. Wordings of one notice at one place count once, the one that fits best.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; a null doc_id and repeated rows are
kept; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common
from inkgauge.llm.licence_texts import BASE, NOTICES

ANCHORS, AGREE, SLACK, COVERAGE = 6, 2, 4, 0.5
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Template:
    """A notice's words with their weights, key phrases, and the positions by which files are looked up."""

    def __init__(self, label: str, text: str, keys: tuple[str, ...], base: bool, idf: dict[bytes, float]) -> None:
        self.label, self.base, self.words, self.keys = label, base, words_of(text), [words_of(k) for k in keys]
        self.weights = [idf[w] for w in self.words]
        self.whole = sum(self.weights) or 1.0
        rare = sorted(set(self.words), key=lambda w: (-idf[w], self.words.index(w)))[: 1 if base else ANCHORS]
        self.anchors = {w: [q for q, x in enumerate(self.words) if x == w] for w in rare}
        self.agree = min(AGREE, len(rare))
        #: Words that may move the place where the next ones are expected.
        self.sure = sorted(self.weights)[len(self.weights) // 2]

    def laid(self, words: list[bytes], start: int) -> tuple[float, int, int]:
        """Share of the weight that stands in place from start on, and the first and last file position met (none: -1)."""
        met, drift, first, last = 0.0, start, -1, -1
        for q, (word, weight) in enumerate(zip(self.words, self.weights)):
            at = q + drift
            near = next((p for d in range(SLACK + 1) for p in ((at + d, at - d) if d else (at,)) if last < p < len(words) and p >= 0 and words[p] == word), None)
            if near is not None:
                met, first, last = met + weight, near if first < 0 else first, near
                if weight >= self.sure:
                    drift = near - q
        return met / self.whole, first, last


class Index:
    """Postings of the templates' rare words; frequencies: how many of n_docs documents hold a word."""

    def __init__(self, frequencies: dict[bytes, int], n_docs: int, base: tuple = BASE, notices: tuple = NOTICES) -> None:
        self.idf = {w: math.log((2 + n_docs) / (1 + frequencies.get(w, 0))) for w in vocabulary(base, notices)}
        self.templates = [Template(*x, True, self.idf) for x in base] + [Template(*x, False, self.idf) for x in notices]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(self.templates):
            for word, places in template.anchors.items():
                self.postings[word] += [(t, q) for q in places]

    def starts(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, start) that enough of its words agree on, in order."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in self.postings:
                places[w].append(p)
        proposed: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for w in sorted(places, key=lambda w: -self.idf[w]):
            for t, q in self.postings[w]:
                proposed[t] += [(p - q, w) for p in places[w]]
        for t, found in sorted(proposed.items()):
            template = self.templates[t]
            if template.base:
                yield from ((t, s) for s in sorted({s for s, _ in found}))
                continue
            found.sort()
            taken, i = -len(words), 0
            for k, (start, _) in enumerate(found):
                while found[i][0] < start - SLACK:
                    i += 1
                if start - taken > SLACK and len({w for _, w in found[i : k + 1]}) >= template.agree:
                    taken = start
                    yield t, found[i][0]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int, int, float, bool]], float]:
        """Accepted matches (label, start, end, coverage, base) and the score of a file's words."""
        found, best, placed = [], 0.0, []
        for t, start in self.starts(words):
            template = self.templates[t]
            if template.base:
                if start >= 0 and words[start : start + len(template.words)] == template.words:
                    found.append((template.label, start, start + len(template.words), 1.0, True))
                    best = 1.0
                continue
            covered, first, last = template.laid(words, start)
            own = words[max(0, first - SLACK) : last + 1 + SLACK]
            if covered >= COVERAGE and all(_holds(own, key) for key in template.keys):
                placed.append((template.label, first, last + 1, covered, len(template.words)))
            else:  # without its key phrases a notice is half a hint at most
                best = max(best, min(covered, 1.0) / 2)
        # wordings of one notice that begin together: the one that fits best, then the longest
        kept: list[tuple[str, int, int, float, int]] = []
        ranges: dict[str, list[tuple[int, int]]] = defaultdict(list)  # of the kept, which are apart, so only neighbours can overlap
        for match in sorted(placed, key=lambda m: (-round(m[3], 2), -m[4], m[1])):
            own = ranges[match[0].split("-")[0]]
            at = bisect.bisect_left(own, (match[1], match[2]))
            if (at == 0 or own[at - 1][1] <= match[1]) and (at == len(own) or match[2] <= own[at][0]):
                own.insert(at, (match[1], match[2]))
                kept.append(match)
        found += [(label, a, b, min(1.0, covered), False) for label, a, b, covered, _ in sorted(kept, key=lambda m: (m[1], m[0]))]
        return found, min(1.0, max([best, *(m[3] for m in kept)]))


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(w == phrase[0] and words[k : k + len(phrase)] == phrase for k, w in enumerate(words))


def vocabulary(base: tuple = BASE, notices: tuple = NOTICES) -> set[bytes]:
    return {w for row in (*base, *notices) for w in words_of(row[1])}


def frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """How many documents hold each word of the templates, and how many documents there are."""
    wanted = vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for some in common.portions(batch):
                for text in common.texts(some):
                    seen.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([*seen, b""], pa.binary()), pa.array([*seen.values(), n], pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {bytes(r["word"]): r["n"] for r in counted.collect()}  # a row for each word of the templates
    return got, got.pop(b"", 0)


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()), ("base", pa.bool_())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, matches (label, start and end in words, coverage, base) and score of every document."""
    docs = common.columns(docs, doc_id="long", text="string")
    known = frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*known)
        for whole in batches:
            for batch in common.portions(whole):
                sizes, matches, scores = [], [], []
                for text in common.texts(batch):
                    words = words_of(text)
                    found, score = index.scan(words)
                    sizes.append(len(words))
                    matches.append([dict(zip(("label", "start", "end", "coverage", "base"), m)) for m in found])
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(matches, _MATCH), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "matches", "score"])

    return docs.mapInArrow(run, "doc_id long, n_words long, matches array<struct<label:string,start:long,end:long,coverage:double,base:boolean>>, score double")


def sql() -> str:
    """The base phrases in DuckDB's SQL: every place of every text against each phrase."""
    phrases = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
    listed = ", ".join(f"({[*p.split()]}, '{label}')" for p, label in phrases)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES {listed}),
place AS (SELECT rid, label, phrase, w, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM d, p WHERE len(w) >= len(phrase)),
hit AS (SELECT rid, label, i - 1 AS found FROM place WHERE w[i] = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
each AS (SELECT rid, count(*) AS n_base, min(found) AS first_word, max(found) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels
FROM d LEFT JOIN each USING (rid)"""
