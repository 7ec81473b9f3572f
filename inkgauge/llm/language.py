"""Languages by nearest centroid: TF-IDF vectors of letter n-grams, several clustered centroids a language, cosine, rejection by distance.

A text becomes counts of its n-grams of 1 to GRAMS lower-case letters (everything else is a gap, one blank long), by hash in WIDTH places;
its vector is log(1 + count) times the inverse document frequency, of length one. Frequencies are counted over all rows that may teach.
Each language's rows are clustered by cosine into up to CENTROIDS centroids, in ROUNDS rounds, on a sample of about SAMPLE rows a language
chosen by hash; each round's sums are made in the tasks and added up by Spark. A text is of the language of the nearest centroid. It
is rejected where its cosine is below the language's limit: the mean cosine of the sample's rows to their own language's nearest centroid
less REJECT deviations. A cluster of less than STRAY of its language's sample is taken for
mislabelled rows and dropped. The driver holds the centroids: WIDTH numbers for each language and cluster.

Defined cases: a null text, and one without a letter, is UNKNOWN with score 0; an empty table gives no rows; held-out rows and rows of a
null id or a null language teach nothing, and where nothing teaches all is UNKNOWN. Repeated rows count as often as they occur. Equal
cosines go to the language that sorts first. Texts of any length are read whole, in blocks. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common

GRAMS, WIDTH, CENTROIDS, ROUNDS, SAMPLE, REJECT, STRAY = 3, 8192, 4, 5, 1_000, 3.0, 0.06
UNKNOWN = "und"
#: How sharply the score falls between languages; characters of a block; texts whose vectors are held at once.
SHARPNESS, BLOCK, TEXTS = 20.0, 1 << 20, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no language may be learnt from. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """How often the n-grams of each place occur, or None without a letter."""
    total, found, tail = np.zeros(WIDTH, np.int64), False, np.zeros(0, np.uint64)
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        own = np.where(letters()[points], points, 32)
        found = found or bool((own != 32).any())
        own = np.concatenate([tail if at else np.array([32]), own, [] if at + BLOCK < len(text) else [32]]).astype(np.uint64)
        own = own[np.r_[True, (own[1:] != 32) | (own[:-1] != 32)]]  # gaps are one blank long
        new = len(tail) if at else 0  # n-grams inside the tail are counted already
        code = np.zeros(len(own), np.uint64)
        for n in range(1, GRAMS + 1):
            code = (code[: len(own) - n + 1] if n > 1 else code) * _ODD + own[n - 1 :] + np.uint64(n)
            ends = np.arange(n - 1, len(own)) >= new
            whole = ends & (own[n - 1 :] != 32) if n == 1 else ends
            mixed = code ^ (code >> np.uint64(29))
            total += np.bincount(((mixed * _ODD) >> np.uint64(64 - WIDTH.bit_length() + 1))[whole].astype(np.int64), minlength=WIDTH)
        tail = own[-(GRAMS - 1) :]
    return total if found else None


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of texts, and whether each has a letter."""
    x, known = np.zeros((len(texts), WIDTH), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if text and (found := counts(text)) is not None:
            x[i], known[i] = np.log1p(found) * idf, True
    lengths = np.sqrt((x * x).sum(1, dtype=np.float64))
    return x / np.where(lengths > 0, lengths, 1)[:, None].astype(np.float32), known


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of characters and of texts."""
    for whole in batches:
        for part in common.portions(whole):
            for at in range(0, part.num_rows, TEXTS):
                yield part.slice(at, TEXTS)


def summed(rows: DataFrame, width: int, value: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over batches of an array of that width; added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in small(batches):
            total += value(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "value"])

    out = np.zeros(width)
    got = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # width rows at most
    out[got.column("at").to_numpy()] = got.column("value").to_numpy()
    return out


@dataclass
class Model:
    """Inverse document frequencies; languages in order; centroids with their languages' numbers; the least cosine of each language."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """The cosine of each row to the nearest centroid of each language."""
        near = x @ self.centroids.T
        return np.stack([near[:, self.owner == k].max(1) for k in range(len(self.languages))], 1)

    def judged(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cosine and rejection of each text."""
        n = len(texts)
        if not self.languages or not n:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        x, known = vectors(texts, self.idf)
        cosine = self.cosines(x)
        best = cosine.argmax(1)
        top = cosine[np.arange(n), best].astype(float)
        score = 1 / np.exp(SHARPNESS * (cosine.astype(float) - top[:, None])).sum(1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, score, 0.0), np.where(known, top, 0.0), ~known | (top < self.limits[best])


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> Model:
    """The model of the languages (lang) of documents, from the rows that may be learnt from."""
    spark = docs.sparkSession
    docs = common.columns(docs, doc_id="long", text="string", lang="string")
    may = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = common.table(may.groupBy("lang").count(), "language-counts")
    sizes = {r["lang"]: r["count"] for r in known.collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model(np.zeros(WIDTH), [], np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0))

    def present(batch: pa.RecordBatch) -> np.ndarray:
        found = [c for t in common.texts(batch) if (c := counts(t)) is not None]
        return sum(((c > 0).astype(float) for c in found), np.zeros(WIDTH))

    total = sum(sizes.values())
    idf = np.log((1 + total) / (1 + summed(may.select("text"), WIDTH, present))) + 0.1  # what is everywhere still counts a little
    # a row is in the sample by its own hash: about sample rows of each language, and all of a rare one
    chance = (F.xxhash64("doc_id", "text") % 1_000_000 + 1_000_000) % 1_000_000
    wanted = known.select("lang", (F.lit(1_000_000.0 * sample) / F.col("count")).alias("below"))
    some = may.join(F.broadcast(wanted), "lang").where(chance < F.col("below")).select(chance.alias("chance"), "text", "lang")
    some = common.table(some, "language-sample")
    number = {name: k for k, name in enumerate(languages)}

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("chance"), pa.array([counts(t) is not None for t in common.texts(batch)], pa.bool_())], names=["lang", "chance", "lettered"])

    # a language's clusters start at the rows of its smallest chances
    ranked = some.mapInArrow(seeds, "lang string, chance long, lettered boolean").where("lettered").select("lang", "chance").distinct()
    first = {r["lang"]: sorted(r["c"])[:centroids] for r in ranked.groupBy("lang").agg(F.collect_set("chance").alias("c")).collect()}  # about sample numbers a language

    owner = np.repeat(np.arange(len(languages)), centroids)
    cluster_of = {(name, chance): number[name] * centroids + j for name, own in first.items() for j, chance in enumerate(own)}
    n = len(owner)

    def started(batch: pa.RecordBatch) -> np.ndarray:
        x, _ = vectors(common.texts(batch), idf)
        out = np.zeros((n, WIDTH + 1))
        for v, name, chance in zip(x, batch.column("lang").to_pylist(), batch.column("chance").to_pylist()):
            if (name, chance) in cluster_of:
                out[cluster_of[name, chance], :-1] += v
                out[cluster_of[name, chance], -1] += 1
        return out.ravel()

    def unit(sums: np.ndarray) -> np.ndarray:
        lengths = np.sqrt((sums * sums).sum(1))
        return (sums / np.where(lengths > 0, lengths, 1)[:, None]).astype(np.float32)

    sums = summed(some, n * (WIDTH + 1), started).reshape(n, -1)
    middle = unit(sums[:, :-1])
    moments, held = np.zeros((len(languages), 3)), np.zeros(n)
    for _ in range(rounds):

        def of(batch: pa.RecordBatch, middle: np.ndarray = middle) -> np.ndarray:
            x, lettered = vectors(common.texts(batch), idf)
            own = np.array([number[name] for name in batch.column("lang").to_pylist()])
            near = np.where(owner[None, :] == own[:, None], x @ middle.T, -1.0)
            best, top = near.argmax(1), near.max(1)
            out, spread = np.zeros((n, WIDTH)), np.zeros((len(languages), 3))
            inside = np.bincount(best[lettered], minlength=n)
            for k in np.unique(best[lettered]):
                out[k] = x[lettered & (best == k)].sum(0)
            np.add.at(spread, own[lettered], np.stack([np.ones(lettered.sum()), top[lettered], top[lettered] ** 2], 1))
            return np.concatenate([out.ravel(), spread.ravel(), inside])

        got = summed(some, n * WIDTH + 3 * len(languages) + n, of)
        moved, moments, held = got[: n * WIDTH].reshape(n, WIDTH), got[n * WIDTH : -n].reshape(-1, 3), got[-n:]
        middle = np.where(moved.any(1)[:, None], unit(moved), middle)
    common.drop(some)
    common.drop(known)
    filled = middle.any(1) & (held >= STRAY * moments[owner, 0])
    mean = moments[:, 1] / np.maximum(moments[:, 0], 1)
    deviation = np.sqrt(np.maximum(moments[:, 2] / np.maximum(moments[:, 0], 1) - mean**2, 0))
    there = [k for k in range(len(languages)) if filled[owner == k].any()]
    renumbered = {k: i for i, k in enumerate(there)}
    keep = np.array([f and o in renumbered for f, o in zip(filled, owner)], bool)
    return Model(idf, [languages[k] for k in there], middle[keep], np.array([renumbered[o] for o in owner[keep]], int), (mean - REJECT * deviation)[there])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), cosine and rejected of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names, score, cosine, rejected = model.judged(common.texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return common.columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")
