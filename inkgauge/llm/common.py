"""Shared pieces: scratch tables in the cluster's shared folder, word splitting, range-readable files."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.functions.ship import ship

#: Word pattern of the contracts: everything that isn't ASCII punctuation, space or control.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White-space separated words.
TOKEN_CLASS = r"[^\x20\x09-\x0D]+"
#: What lies between words.
GAP_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see: spark.checkpoint.dir. Where that is unset, one of our own in a local master; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="inkgauge-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: a cut of the lineage that lost executors cannot take away."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table() whose rows no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)
        for own in [p for p in _scratch if path.endswith(p.rsplit("/", 1)[1])]:
            _scratch.remove(own)


def made_by(work: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """What work returns, and the scratch paths that it made; release() them when every result that reads them is consumed."""
    before = set(_scratch)
    return work(), [p for p in _scratch if p not in before]


def release(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        delete(spark, path)
        if path in _scratch:
            _scratch.remove(path)


def clear_scratch() -> None:
    """Delete what is left in the shared folder; done when the driver ends, while its session lives."""
    from pyspark import SparkContext

    spark = SparkSession.getActiveSession()
    if spark is not None and SparkContext._active_spark_context is not None:
        release(spark, list(_scratch))


atexit.register(clear_scratch)


#: A key with more than one row in HOT of all is hot; there are fewer than HOT such keys, whatever the data.
HOT = 1000


def join_hot(big: DataFrame, side: DataFrame, key: str, copies: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with side, which has one row a key and in copies the number of big's rows of that key; total: all of big's rows.

    Fewer than HOT hot keys are broadcast, so their rows stay where they are; the other keys are shuffled.
    """
    hot = F.col(copies) * HOT > total
    few, rest = side.where(hot).drop(copies), side.where(~hot).drop(copies)
    spread = big.join(F.broadcast(few), key)
    return spread.unionByName(big.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key, how))


def checked_broadcast(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df, a written table, to be broadcast if its strings and numbers are most bytes at the most; else Spark shuffles it."""
    sizes = [F.octet_length(F.to_json(F.struct(c))) if "<" in kind else F.octet_length(c) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    held = df.agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(16)))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is the same where no other letter has a case to lose, and much faster than translate()."""
    return F.when(F.rlike(text, F.lit(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The words (WORD_CLASS) of a text: what lies between GAP_CLASS. Splitting is many times faster than extracting."""

    def inner(w: Column) -> Column:
        first, last = (w[0] == "").cast("int"), (F.element_at(w, -1) == "").cast("int")
        return F.slice(w, first + 1, F.greatest(F.size(w) - first - last, F.lit(0)))

    return F.transform(F.array(F.split(text, GAP_CLASS, -1)), inner)[0]


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label may be learnt from. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast to their kinds: what an operator takes from a table that may have any others."""
    ship(df.sparkSession)
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def portions(batch: pa.RecordBatch, most: int = 1_000_000, name: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of about most bytes of text (one long text is a part of its own), so that a worker turns a bounded amount into Python objects at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    for lo, hi in spans_of(sizes, most):
        yield batch.slice(lo, hi - lo)


#: What clears each cache that outlives a worker's tasks.
_caches: dict[str, Callable[[], None]] = {}


def only_cache(name: str, clear: Callable[[], None]) -> None:
    """Register a worker's cache and empty all others: a worker that is used by another operator holds one operator's cache."""
    for other in [k for k in _caches if k != name]:
        _caches.pop(other)()
    _caches[name] = clear


def spans_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut 0..len(sizes) into runs whose sizes sum to about most, so that a worker holds a bounded amount at once."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def filesystem(uri: str):
    """A pyarrow file system and path for a URI or a plain path, on driver and executors alike."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
