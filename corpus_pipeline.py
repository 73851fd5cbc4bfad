"""A corpus pipeline: each stage reads what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semcat.llm.common import free_name, remainder, sent, stored
from semcat.llm.decontaminate import without_contaminated
from semcat.llm.langid import fit_tagger, identify
from semcat.llm.mixing import mixing_plan
from semcat.llm.ngramjoin import near_copies
from semcat.llm.suffixdedup import deduplicated

# Mean probability of the best language below which a text is in none of them.
LEAST_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts, texts without a letter and texts in no language go."""
    learned = docs.where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang")
    found = identify(docs, fit_tagger(learned))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows that agree in id and text are one, the first by a hash of all columns; rows
    without an id stay, as do other texts of an id.
    """
    groups = near_copies(docs)
    dropped = groups.where("component_id != doc_id").select("doc_id").distinct()
    left = docs.join(sent(dropped), "doc_id", "left_anti")
    again = sent(groups.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"))
    single = left.join(again, "doc_id", "left_anti")
    place = free_name(docs, "place")
    own = Window.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    once = left.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(own)).where(F.col(place) == 1)
    return single.unionByName(once.select(*single.columns)).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without strings of 100 bytes that stand earlier; n_chars follows the text."""
    cut = deduplicated(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, how often, and how many words that gives."""
    plan = mixing_plan(docs).where("taken > 0")
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# The network and the transforms cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
