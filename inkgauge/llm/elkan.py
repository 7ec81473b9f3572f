"""Lloyd's rounds over whole numbers with Elkan's bounds, kept beside each vector between the rounds.

A vector is cut into equal parts, each with a book of entries (one part: plain clustering). A row's state is, for each part, its entry, an
upper bound of the distance to it and a lower bound of the distance to every entry. A round shifts the bounds by how far entries moved,
and works out distances only where no triangle inequality rules an entry out: an entry is passed over if the upper bound is strictly
below its lower bound or below half the distance between the two entries. Bounds are rounded away from what they bound, and comparisons
that decide are between whole squared distances, so pruning never changes a result and ties go to the smaller number.

The state is a table in the shared folder, written anew by each round; lower bounds take a byte each, in steps of the first book's
extent, rounded down. Sums of a round are made in the tasks and added up by Spark; the driver holds the books and nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common

#: Factors that outweigh the rounding errors of a root, a sum and a product.
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48
#: Rows whose bounds are held at once; pairs of a row and an entry whose differences are; lower bounds a book's extent.
BLOCK, PAIRS, STEPS = 2_048, 65_536, 160
#: Share of all pairs from which one matrix product is cheaper than the pairs.
DENSE = 0.08


def root_up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * UP


def root_down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * DOWN


def largest(length: int) -> int:
    """The largest component that this module computes with: squared distances of vectors of that length stay below 2^60."""
    return 1 << int((60 - np.log2(max(1, length))) / 2 - 1)


def whole(embedding: Column, factor: int, most: Column | int) -> Column:
    """floor(factor * x) of each component as double, within -most..most."""
    bound = F.lit(most) if isinstance(most, int) else most
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x * factor, bound.cast("double")), -bound.cast("double"))).cast("int"))


def sound(embedding: Column) -> Column:
    """Whether an array is there and all its components are finite numbers."""
    return F.coalesce(F.forall(embedding.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries: by floats while they hold every sum exactly, else by integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 2**52 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]).astype(np.int64)


def between(x: np.ndarray, entries: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs."""
    if len(row) > DENSE * len(x) * len(entries):
        return squares(x, entries)[row, entry]
    out = np.empty(len(row), np.int64)
    for at in range(0, len(row), PAIRS):
        apart = x[row[at : at + PAIRS]] - entries[entry[at : at + PAIRS]]
        out[at : at + PAIRS] = (apart * apart).sum(1)
    return out


@dataclass
class Book:
    """A part's entries, what half the distances between them are at least, how far each moved since the round before at most, and the step of lower bounds."""

    entries: np.ndarray
    half: np.ndarray
    move: np.ndarray
    step: float

    @classmethod
    def of(cls, entries: np.ndarray, before: Book | None = None) -> Book:
        gaps = squares(entries, entries)
        half = root_down(gaps) / 2
        np.fill_diagonal(half, np.inf)
        apart = entries - before.entries if before else np.zeros_like(entries)
        step = before.step if before else float(np.sqrt(gaps.max(initial=0))) / STEPS or 1.0
        return cls(entries, half, root_up((apart * apart).sum(1)), step)


@dataclass
class Held:
    """The state of some rows in one part."""

    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def started(x: np.ndarray, book: Book) -> Held:
    """The first assignment, by all distances."""
    d = squares(x, book.entries)
    own = d.argmin(1)  # the first of equals
    return Held(own, root_up(d[np.arange(len(x)), own]), root_down(d))


def moved(x: np.ndarray, book: Book, held: Held) -> Held:
    """The next assignment, where the bounds don't rule it out."""
    own, upper = held.own.copy(), (held.upper + book.move[held.own]) * UP
    lower = np.maximum(held.lower - book.move[None, :] * UP, 0.0) * DOWN
    may = (upper[:, None] >= lower) & (upper[:, None] >= book.half[own])
    busy = np.flatnonzero(may.any(1))
    if not len(busy):
        return Held(own, upper, lower)
    apart = x[busy] - book.entries[own[busy]]
    exact = (apart * apart).sum(1)
    upper[busy], lower[busy, own[busy]] = root_up(exact), root_down(exact)
    at, entry = np.nonzero(may[busy] & (upper[busy, None] >= lower[busy]) & (upper[busy, None] >= book.half[own[busy]]))
    if not len(at):
        return Held(own, upper, lower)
    d = between(x[busy], book.entries, at, entry)
    lower[busy[at], entry] = root_down(d)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    least = np.minimum.reduceat(d, starts)
    hits = np.flatnonzero(d == np.repeat(least, np.diff(np.r_[starts, len(at)])))
    rows, first = np.unique(at[hits], return_index=True)  # entries ascend, so the first of equals is the smallest
    found, old = entry[hits[first]], exact[rows]
    better = (least < old) | ((least == old) & (found < own[busy[rows]]))
    won = busy[rows[better]]
    own[won], upper[won] = found[better], root_up(least[better])
    return Held(own, upper, lower)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)


def _stored(batch: pa.RecordBatch, books: list[Book]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = batch.num_rows, len(books[0].entries)
    lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.uint8).reshape(n, len(books), k)
    return batch.column("own").flatten().to_numpy().reshape(n, -1), batch.column("upper").flatten().to_numpy().reshape(n, -1), lower


_STATE = "own array<int>, upper array<double>, lower binary"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.ravel(), kind))


def _schema(rows: DataFrame, columns: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def assigned(rows: DataFrame, books: list[Book], keys: list[str], first: bool) -> DataFrame:
    """rows (keys, v; after the first round also the state) with the state of the next round."""
    width = books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(lo, BLOCK)
                x, parts = _numbers(batch), []
                if not first:
                    own, upper, lower = _stored(batch, books)
                for p, book in enumerate(books):
                    some = x[:, p * width : (p + 1) * width]
                    parts.append(started(some, book) if first else moved(some, book, Held(own[:, p].astype(np.int64), upper[:, p], lower[:, p] * (book.step * DOWN))))
                packed = np.stack([np.clip(np.floor(h.lower / b.step * DOWN), 0, 255).astype(np.uint8) for h, b in zip(parts, books)], 1)
                state = [_lists(np.stack([h.own for h in parts], 1), pa.int32()), _lists(np.stack([h.upper for h in parts], 1), pa.float64()), pa.array([r.tobytes() for r in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, "v"]), *state], names=[*keys, "v", "own", "upper", "lower"])

    return rows.select(*keys, "v", *([] if first else ["own", "upper", "lower"])).mapInArrow(run, _schema(rows, [*keys, "v"]) + ", " + _STATE)


def totals(state: DataFrame, books: list[Book]) -> np.ndarray:
    """For each part and entry the number of its rows and the exact sum of their components, as whole numbers of any size."""
    k, width, parts = *books[0].entries.shape, len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, 1 + width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _numbers(batch), batch.column("own").flatten().to_numpy().reshape(batch.num_rows, -1)
            for p in range(parts):
                order = np.argsort(own[:, p], kind="stable")
                entries, starts = np.unique(own[order, p], return_index=True)
                total[p, entries, 1:] += np.add.reduceat(x[order, p * width : (p + 1) * width], starts, axis=0)
                total[p, entries, 0] += np.diff(np.r_[starts, len(order)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "value"])

    out = np.zeros(parts * k * (1 + width), object)
    summed = state.select("v", "own").mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    for r in summed.collect():  # parts * k * (1 + width) rows at most
        out[r["at"]] = int(r["value"])
    return out.reshape(parts, k, 1 + width)


def updated(books: list[Book], sums: np.ndarray) -> list[Book]:
    """Each entry that has rows becomes their componentwise floor(sum / count)."""
    made = []
    for p, book in enumerate(books):
        entries = book.entries.copy()
        for e in np.flatnonzero(sums[p, :, 0]):
            entries[e] = [v // sums[p, e, 0] for v in sums[p, e, 1:]]
        made.append(Book.of(entries, book))
    return made


def final(state: DataFrame, books: list[Book], keys: list[str]) -> DataFrame:
    """keys, own and squares (exact squared distances to the own entries, by part) of a state."""
    width = books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _numbers(batch), batch.column("own").flatten().to_numpy().reshape(batch.num_rows, -1)
            apart = [x[:, p * width : (p + 1) * width] - b.entries[own[:, p]] for p, b in enumerate(books)]
            d = np.stack([(a * a).sum(1) for a in apart], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), batch.column("own"), _lists(d, pa.int64())], names=[*keys, "own", "squares"])

    return state.select(*keys, "v", "own").mapInArrow(run, _schema(state, keys) + ", own array<int>, squares array<long>")


def lloyd(rows: DataFrame, start: list[np.ndarray], keys: list[str], rounds: int, name: str) -> tuple[DataFrame, list[np.ndarray]]:
    """rows (keys, v) after so many rounds of assignment and update and one more assignment: a table of keys, own and squares; and the last entries by part.

    rows is a table in the shared folder; start has an array (k, width) for each part, all of one shape.
    """
    books = [Book.of(e.astype(np.int64)) for e in start]
    state = common.table(assigned(rows, books, keys, True), name)
    for _ in range(rounds):
        books = updated(books, totals(state, books))
        before, state = state, common.table(assigned(state, books, keys, False), name)
        common.drop(before)
    out = common.table(final(state, books, keys), name + "-final")
    common.drop(state)
    return out, [b.entries for b in books]
