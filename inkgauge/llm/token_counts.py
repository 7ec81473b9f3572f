"""Token counts from flat, unindexed token files by a separator scan.

A flat file is nothing but ids, documents ended by a separator id that no text can give. Files are cut into blocks of equal
length wherever that falls; each block is searched for separators by numpy on its own, and a prefix scan over a file's
blocks (separators before the block, place of the last one) stitches the documents that cross block edges.

Defined cases: a null or empty text counts 1, its separator; a null doc_id and repeated rows are kept; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm import bpe, common


def write_flat(docs: DataFrame, folder: str | None = None, vocabulary: str = "byte_bpe_50k.json", separator: int = 50256) -> DataFrame:
    """One flat file of little-endian uint16 for each partition; returns a row for each document in file order: file, path, ordinal, doc_id.

    separator must be an id that encoding never gives: texts' special tokens are encoded as ordinary text.
    """
    spark = docs.sparkSession
    folder = folder or common.scratch_path(spark, "flat-tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, part, n = None, "", TaskContext.get().partitionId(), 0
        try:
            for batch in batches:
                if out is None:
                    coder = bpe.encoder(vocabulary, plain=True)
                    if max(coder.vocabulary, separator + 1) > 1 << 16:
                        raise ValueError("flat files hold ids of 16 bits")
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.u16"
                    system, local = common.filesystem(path)
                    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(local)
                ids = batch.column("doc_id")
                for some in common.portions(batch):
                    out.write(bpe.encode_with_end(coder, some.column("text"), separator)[0].astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array([path] * len(ids), pa.string()), pa.array(np.arange(n, n + len(ids))), ids], names=["file", "path", "ordinal", "doc_id"])
                n += len(ids)
        finally:
            if out is not None:
                out.close()

    named = common.columns(docs, doc_id="long", text="string")
    return common.table(named.mapInArrow(encode, "file int, path string, ordinal long, doc_id long"), "flat-documents")


def scan(files: DataFrame, separator: int = 50256, block: int = 1 << 21) -> DataFrame:
    """Counts of the documents in flat files (file, path): file, ordinal, n_tokens with the separator.

    A tail without a separator is no document.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = []
            for path in batch.column("path").to_pylist():
                system, local = common.filesystem(path)
                lengths.append(system.get_file_info(local).size // 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int64())], names=[*batch.schema.names, "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, k in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "block"))):
                system, local = common.filesystem(path)
                with system.open_input_file(local) as f:
                    found = np.flatnonzero(np.frombuffer(f.read_at(2 * block, 2 * block * k), "<u2") == separator)
                gaps = np.diff(found, prepend=-1).astype(np.int64)  # the first one counts from the block's edge
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([k], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([int(found[-1]) if len(found) else None], pa.int64()), pa.array([gaps.tolist()], pa.list_(pa.int64()))], names=["file", "block", "n_found", "last", "gaps"])

    blocks = (
        files.select("file", "path").distinct().mapInArrow(sizes, "file int, path string, n long").where("n > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {block}L)"))).repartition("file", "block")
    )
    found = blocks.mapInArrow(search, "file int, block long, n_found long, last long, gaps array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edge = F.col("block") * block
    stitched = found.select(
        "file",
        F.coalesce(F.sum("n_found").over(before), F.lit(0)).alias("first"),
        # ids between the last separator of earlier blocks and this block's edge belong to the first document that ends here
        (edge - F.coalesce(F.max(edge + F.col("last") + 1).over(before), F.lit(0))).alias("carried"),
        "gaps",
    )
    each = stitched.select("file", "first", "carried", F.posexplode("gaps").alias("k", "gap"))
    return each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("gap") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"))


def counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", separator: int = 50256, block: int = 1 << 21) -> DataFrame:
    """doc_id, n_tokens of every document, by writing flat files and scanning them."""
    listed = write_flat(docs, None, vocabulary, separator)
    # both sides have a row for each document: neither is ever broadcast
    return listed.select("file", "ordinal", "doc_id").join(scan(listed, separator, block).hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
