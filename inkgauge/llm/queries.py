"""The registered queries of this subpackage: each operator over its whole table, in its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import clustering, common, decontamination, language, licenses, neardup, packing, quality, quality_rules, secret_scan, token_counts, token_files, toxicity, vector_codes
from inkgauge.sources import tables


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tables.read(spark, sf_dir, table)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents")).withColumn("base", F.filter("matches", lambda m: m["base"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined("base").alias("base_labels"), joined("matches").alias("labels"), "score"
    )


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_license_scan finds of the base phrases: the columns that SQL can express."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_files.read(token_files.write(_read(spark, sf_dir, "documents")))
    return docs.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.columns(_read(spark, sf_dir, "documents"), doc_id="long", text="string")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), slack=None))


def decontamination_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator's proximity matches: per document the items that stand near, and the words between the first and the last rare term of each."""
    found = decontamination.hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_near = F.aggregate("near_spans", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])
    return found.select("doc_id", F.size("near_items").cast("long").alias("n_near_items"), n_near.alias("n_near"), F.array_join("near_items", ",").alias("near_items"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(_read(spark, sf_dir, "documents")).drop("clean_text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(_read(spark, sf_dir, "documents")))


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_secret_scan finds of the base kinds: the columns that SQL can express."""
    return op8_secret_scan(spark, sf_dir).drop("spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, votes = toxicity.fit_votes(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    scored = toxicity.score_votes(votes, model)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).withColumn("held_out", language.held_out(F.col("doc_id")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.encode(_read(spark, sf_dir, "embeddings")))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digest(*clustering.cluster(_read(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_files, op3_token_counts, op4_quality, op5_decontamination, op6_quality_rules, op7_packing, op8_secret_scan, op9_toxicity, op10_near_dedup, op11_language_id, op12_vector_codes, op13_centroid_clusters, decontamination_near, license_base, secret_base)}


def oracle_sql() -> dict[str, str]:
    return {"license_base": licenses.sql(), "secret_base": secret_scan.sql(), "op10_near_dedup": neardup.sql(), "op5_decontamination": decontamination.sql(), "op6_quality_rules": quality_rules.sql(), "op12_vector_codes": vector_codes.sql(), "op13_centroid_clusters": clustering.sql()}
