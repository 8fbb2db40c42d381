"""The registered queries of the operators, and their results in SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import compression, decontamination, doubling, forest, licenses, merkle, mixing, nra, repetition, sharding, toxicity, viterbi, windows
from tillstream.llm.oracles import ORACLES
from tillstream.llm.tables import fold

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return repetition.repetition(table(spark, sf_dir, "documents")).select(*figures)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.deduplicated(table(spark, sf_dir, "documents")).drop("spans")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def _predicted(scores: DataFrame, held_out: Column, least: float) -> DataFrame:
    predicted = (F.col("score") >= least).cast("int").alias("predicted")
    return scores.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    return _predicted(toxicity.toxicity(docs, model), fold(F.col("doc_id"), 5) == 0, 0.5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of over 50 words that nearly repeat one of an earlier document, with that document's id."""
    return windows.passages(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression.train(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    return _predicted(compression.quality(docs, model), fold(F.col("doc_id"), 4) == 2, 0.7)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sharding": op13_sharding,
}