"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from semcat.llm.common import remainder, stored
from semcat.llm.decontaminate import contaminated
from semcat.llm.katz import katz_scores
from semcat.llm.langid import fit_tagger, identify
from semcat.llm.merkle import document_manifest, folded, proof_digest
from semcat.llm.mixing import mixing_plan
from semcat.llm.neardup import similar_vectors
from semcat.llm.ngramjoin import near_copies
from semcat.llm.oracles import ORACLES
from semcat.llm.quality import document_statistics, fit_quality, score_quality
from semcat.llm.spelling import spelling_variants
from semcat.llm.suffixdedup import without_repeats
from semcat.llm.tokencount import WORD_BPE, count_tokens
from semcat.llm.topksearch import top_inner_products
from semcat.llm.toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each document gives to a mix with weights 1, 2, 3 by source."""
    plan = mixing_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a Katz bigram model."""
    held_out = remainder("doc_id", 5) == 1
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    scored, tokens = katz_scores(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are similar to 0.85."""
    return near_copies(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the recurrent network over its bytes."""
    docs = _table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = fit_tagger(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", found["lang_score"].alias("score"))


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One label per document: 1 if any of its rows says so."""
    return _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(name).alias(name))


def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by two Kneser-Ney models."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    model = fit_toxicity(docs, _labels(spark, sf_dir, "toxic").where(~held_out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op6_two_tier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, WORD_BPE)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by ridge regression on random Fourier features."""
    stats = stored(document_statistics(_table(spark, sf_dir, "documents")), "doc_stats")
    held_out = remainder("doc_id", 4) == 2
    labels = _labels(spark, sf_dir, "quality").withColumnRenamed("quality", "label")
    model = fit_quality(stats.where(~held_out).join(labels, "doc_id"))
    scored = score_quality(stats, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


def op9_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of embeddings with cosine 0.98 or more under one label."""
    return similar_vectors(_table(spark, sf_dir, "embeddings"))


def op10_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without strings of 100 bytes that stand earlier."""
    cut = without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that it gives after tampering."""
    doc_id = F.col("doc_id").cast("string")
    tampered = F.when(F.crc32(doc_id) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = document_manifest(_table(spark, sf_dir, "documents"), tampered)
    proved = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the more frequent spelling of each, and where such spellings lead."""
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for every hundredth embedding, by inner product."""
    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


QUERIES = {
    "op1_pareto_mixing": op1_pareto_mixing,
    "op2_kneser_ney_toxicity": op2_kneser_ney_toxicity,
    "op3_katz_backoff": op3_katz_backoff,
    "op4_grouped_prefix_join": op4_grouped_prefix_join,
    "op5_byte_gru": op5_byte_gru,
    "op6_two_tier_tokens": op6_two_tier_tokens,
    "op7_cgk_decontamination": op7_cgk_decontamination,
    "op8_fourier_quality": op8_fourier_quality,
    "op9_rotation_codes": op9_rotation_codes,
    "op10_interval_expansion": op10_interval_expansion,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_threshold_search": op13_threshold_search,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["ORACLES", "QUERIES"]
