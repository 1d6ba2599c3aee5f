"""A training corpus from raw documents, stage by stage; each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import decontaminate, language, pieces, simhash, toxicity
from rookery.llm.common import read
from rookery.session import stage

#: No SQL: the stages hold trained models, fingerprints and sub-word ids. The tests compare them with brute force.
ORACLE_SQL = None


#: A document whose language is less certain than this is rejected, as is one without a language.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty; what it was labelled before is no input and stays."""
    judged = docs.withColumn("_language_verdict", language.verdict(docs))
    told = (F.col("_language_verdict.lang_pred") != "und") & (F.col("_language_verdict.score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(told).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the given labels, does not call toxic."""
    judged = docs.withColumn("_toxicity_verdict", toxicity.verdict(docs, read(spark, sf_dir, "labels")))
    return judged.where(F.col("_toxicity_verdict.p_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What training reads: the piece ids of every kept document, which decode to its text."""
    return pieces.encode_pieces(docs, pieces.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentence_pieces", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents below ``sf_dir``; every stage's table goes to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
