"""Concatenate and cut: token sequences of a fixed window over the whole corpus, without a shuffle.

Pass 1 encodes each document once and stores its ids with the running total inside its partition. The partitions' totals
(one number each) become global offsets by a prefix sum; pass 2 reads the stored ids and cuts at multiples of the window.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed as often as they
occur; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import bpe, common

_TOKENS = "part int, local_start long, doc_id long, n long, width int, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Ids that a worker widens at once.
_AT_ONCE = 4_000_000


def tokens(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """A row for each document: its ids as little-endian numbers of width bytes (2, or 4 for a vocabulary beyond 65,536), and their place in the partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, total = bpe.encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = 2 if max(coder.vocabulary, end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for some in common.portions(batch, bpe.PORTION):
                flat, sizes = bpe.encode_with_end(coder, some.column("text"), end_id)
                raw, edges = flat.astype(f"<u{width}").tobytes(), np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(some.num_rows, part, np.int32)),
                        pa.array(total + edges[:-1]),
                        some.column("doc_id"),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(np.full(some.num_rows, width, np.int32)),
                        pa.array([raw[width * a : width * b] for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                    ],
                    names=["part", "local_start", "doc_id", "n", "width", "ids"],
                )
                total += int(edges[-1])

    return common.columns(docs, doc_id="long", text="string").mapInArrow(encode, _TOKENS)


def _cut(batch: pa.RecordBatch, first: np.ndarray, window: int) -> pa.RecordBatch:
    """The pieces of some documents whose ids begin at first in the whole."""
    n, width = batch.column("n").to_numpy(), int(batch.column("width")[0].as_py())
    raw = b"".join(batch.column("ids").to_pylist())
    if len(raw) != width * int(n.sum()):
        raise ValueError("stored ids and their counts disagree")
    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
    pieces = (first + n - 1) // window - first // window + 1
    doc = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sequence = first[doc] // window + k
    begin = np.maximum(first[doc], sequence * window)
    length = np.minimum((first + n)[doc], (sequence + 1) * window) - begin
    edges = np.concatenate([[0], np.cumsum(4 * length)])
    if edges[-1] >= 1 << 31:
        raise ValueError("one document's ids are beyond the 2 GB of a binary column")
    own = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(pa.array(doc)), *map(pa.array, (begin - first[doc], length, n[doc], sequence, begin - sequence * window)), own],
        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, window: int = 1024) -> DataFrame:
    """Pieces of documents in sequences of window ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    All sequences but the corpus' last are full, so there is padding in one sequence at most.
    """
    stored = common.table(tokens(docs, vocabulary, end_id), "packing-tokens")
    # one number a partition of pass 1: bounded by the number of input splits, eight bytes each in a broadcast
    totals = sorted((r.part, r.n) for r in stored.groupBy("part").agg(F.sum("n").alias("n")).collect())
    parts, sums = np.array([p for p, _ in totals], np.int64), np.array([n for _, n in totals], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((parts, np.cumsum(sums) - sums))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, base = sent.value
        for batch in batches:
            first = base[np.searchsorted(parts, batch.column("part").to_numpy())] + batch.column("local_start").to_numpy()
            for lo, hi in common.spans_of(batch.column("n").to_pylist(), _AT_ONCE):
                yield _cut(batch.slice(lo, hi - lo), first[lo:hi], window)

    return stored.mapInArrow(cut, _PIECES)
