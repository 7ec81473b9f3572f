"""Token files of fixed-width packed ids with block offsets.

A file holds its ids in blocks of BLOCK ids, each id in the fewest bits that the vocabulary needs, lowest bit first. A footer
has the blocks' offsets and the documents' ids and starts, so that any id range or document is found with two reads and
unpacked by numpy. Files follow each other in ascending doc_id order; a manifest row for each file has its place in the whole.

    magic, bits | block 0 | block 1 | ... | block offsets | validity of doc ids | doc ids | doc starts | 6 numbers, magic

Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows with equal doc_ids follow each other
by their text's hash; an empty table gives no files; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import bpe, common

MAGIC, BLOCK = b"FWTK", 1 << 16
_FILES = "part int, path string, n_docs long, n_tokens long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits for ids below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # whole bytes: the same layout without touching single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Appends documents to one file; ids leave memory block by block."""

    def __init__(self, uri: str, bits: int) -> None:
        system, path = common.filesystem(uri)
        self.out, self.bits = system.open_output_stream(path), bits
        self.out.write(MAGIC + bytes([bits]))
        self.at, self.offsets, self.pending, self.waiting = 5, [], [], 0
        self.doc_ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.n_tokens = 0

    def add(self, doc_ids: list[int | None], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.pending.append(flat)
        self.waiting += len(flat)
        self.n_tokens += len(flat)
        if self.waiting >= BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        flat = np.concatenate(self.pending)
        for a in range(0, n, BLOCK):
            raw = pack_bits(flat[a : min(n, a + BLOCK)], self.bits)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.pending, self.waiting = [flat[n:]], len(flat) - n

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting)
        ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes or [np.zeros(0, np.int64)]))]).astype("<i8")
        for part in (np.array(self.offsets, "<i8"), known, ids, starts):
            self.out.write(part.tobytes())
        self.out.write(np.array([self.at, len(self.offsets), len(ids), self.n_tokens, BLOCK, self.bits], "<i8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        system, path = common.filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(52, size - 52)
        if tail[48:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        at, n_blocks, n_docs, self.n_tokens, self.block, self.bits = np.frombuffer(tail, "<i8", 6).tolist()
        foot = self.file.read_at(size - 52 - at, at)
        self.offsets = np.append(np.frombuffer(foot, "<i8", n_blocks), at)
        known = np.frombuffer(foot, np.uint8, n_docs, 8 * n_blocks)
        ids = np.frombuffer(foot, "<i8", n_docs, 8 * n_blocks + n_docs)
        self.doc_ids = [i if k else None for i, k in zip(ids.tolist(), known)]
        self.starts = np.frombuffer(foot, "<i8", n_docs + 1, 8 * n_blocks + 9 * n_docs)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, exclusive; only the blocks that hold them are read."""
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block + 1
        raw = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        got, base = [], int(self.offsets[a])
        for k in range(a, b):
            n = min(self.block, self.n_tokens - k * self.block)
            got.append(unpack_bits(raw[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], n, self.bits))
        return np.concatenate(got)[start - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, folder: str | None = None, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Encode all documents into files under folder (the shared folder unless given) and return the manifest: path, base, n_docs, n_tokens.

    A failed attempt's file is in no manifest row, so it is never read.
    """
    spark = docs.sparkSession
    folder = folder or common.scratch_path(spark, "token-files")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, part = None, "", TaskContext.get().partitionId()
        for batch in batches:
            if writer is None:
                coder, path = bpe.encoder(vocabulary), f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.fwtk"
                system, local = common.filesystem(path)
                system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                writer = Writer(path, bits_for(max(coder.vocabulary, end_id + 1)))
            for some in common.portions(batch, bpe.PORTION):
                writer.add(some.column("doc_id").to_pylist(), *bpe.encode_with_end(coder, some.column("text"), end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(writer.doc_ids), "n_tokens": writer.n_tokens}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # equal rows of one id may be many: the last key lets ranges cut between them
    named = common.columns(docs, doc_id="long", text="string").withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    ranged = named.repartitionByRange("doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "nth").select("doc_id", "text")
    manifest = common.table(ranged.mapInArrow(encode, _FILES), "token-manifest")
    files, base, rows = sorted(manifest.collect()), 0, []  # a row for each file, bounded by the number of partitions
    for f in files:
        rows.append((f.part, f.path, base, f.n_docs, f.n_tokens))
        base += f.n_tokens
    return spark.createDataFrame(rows, "part int, path string, base long, n_docs long, n_tokens long")


def read(manifest: DataFrame) -> DataFrame:
    """The files' documents: doc_id, start (ids of all documents before it), ids (little-endian uint32)."""
    n = max(1, manifest.count())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                file = Reader(path)
                for lo, hi in common.spans_of(np.diff(file.starts).tolist(), 500_000):
                    first = int(file.starts[lo])
                    raw = file.ids(first, int(file.starts[hi])).astype("<u4").tobytes()
                    edges = (file.starts[lo : hi + 1] - first).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[lo:hi], pa.int64()), pa.array(base + file.starts[lo:hi]), pa.array([raw[4 * a : 4 * b] for a, b in zip(edges, edges[1:])], pa.binary())], names=["doc_id", "start", "ids"]
                    )

    return manifest.repartitionByRange(n, "part").select("path", "base").mapInArrow(decode, "doc_id long, start long, ids binary")


