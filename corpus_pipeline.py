"""Corpus pipeline: documents to token ids in five stages.

language ID -> quality rules -> near-duplicates -> source mixing -> SentencePiece

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each result as Parquet in the shared checkpoint folder and
gives the table read back to the next stage.  All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import langid, mixing, neardup, pieces, quality
from parley.llm.scratch import keep, prepare


def _packed(docs: DataFrame) -> DataFrame:
    """(_row, text): the whole row as one value, so that none of its columns
    clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (a text without a letter, or far
    from every centroid, goes).  Learned from the labelled two thirds."""
    prepare(spark)
    held = F.coalesce(langid.held_out(F.col("doc_id"), 3, 1), F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.identify(_packed(docs), model).where("NOT rejected").select("_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted votes of the rules accept."""
    prepare(spark)
    measured = keep(quality.measure(_packed(docs)).drop("text"), "measured")
    return quality.judge(measured, quality.fit(measured)).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return neardup.drop_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document once per pass that takes words
    of it, its text being the words taken."""
    prepare(spark)
    return mixing.remix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    prepare(spark)
    return pieces.encode(docs, exact="exact").select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"), "exact")


STAGES = [
    ("language ID", language),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("source mixing", mixture),
    ("SentencePiece", sentencepiece),
]

#: learned models, hashed sketches and draws: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
