"""A training corpus in five stages: quality, near-duplicates, benchmark passages, secrets, packing.

Defined cases: null and empty texts have the classifier's score of the empty text, and stay or go by it like others; they are no
copies of each other, hold no passage and no secret, and are packed as the end id alone. Null ids and repeated rows: copies go in the
second stage, whatever their id; of equal rows one stays. Ties between copies go to the smallest doc_id. An empty table passes
through every stage as an empty table; columns besides doc_id and text are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import common, decontamination, neardup, packing, quality, secret_scan

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5

_made: list[str] = []


def _stage(spark: SparkSession, work: Callable[[], DataFrame]) -> DataFrame:
    """A stage's result. It is written before the next stage begins, which then deletes what the stage before kept in the shared folder."""
    common.release(spark, _made)
    result, paths = common.made_by(work)
    _made[:] = paths
    return result


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""

    def work() -> DataFrame:
        model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return docs.where(quality.score(F.col("text"), model) >= 0.5)

    return _stage(spark, work)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return _stage(spark, lambda: neardup.dedupe(docs, SHINGLE))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _stage(spark, lambda: decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets redacted."""
    return _stage(spark, lambda: secret_scan.without_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full token sequences, with their ids."""
    return _stage(spark, lambda: packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written and read again before the next one, which deletes them when its own are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        common.release(spark, [before] if before else [])
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its ids are stored by now, so the texts may go
    common.release(spark, [before])
    return packed
