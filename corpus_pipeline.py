"""The corpus pipeline: documents in, a mix of clean, distinct, uncontaminated documents with the words to take of each out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, langid, mixing, ngram_join, scratch


#: The least calibrated probability of its language that a document stays with: one language is likelier than all others together.
LEAST_SCORE = 0.5


def _next(spark: SparkSession) -> None:
    """A stage reads the written result of the one before, so what the latter left in the shared folder can go."""
    scratch.clear(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null texts, texts without a letter, and those of which no language reaches LEAST_SCORE.
    The model learns from `docs`; where none has a language it knows no label, and letters alone decide."""
    _next(spark)
    name = scratch.free_name(docs, "language")
    model = langid.train(docs)
    if not model.labels:
        return docs.filter(langid.has_letter("text"))
    found = langid.identify(docs, model, out=name)
    return found.filter((F.col(name)["lang_pred"] != langid.UNKNOWN) & (F.col(name)["score"] >= LEAST_SCORE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    _next(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest id stays."""
    _next(spark)
    return ngram_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more of the words stand in benchmark windows."""
    _next(spark)
    name = scratch.free_name(docs, "c")
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=name)
    n_words, n_hit = F.col(name)["n_words"], F.col(name)["n_hit"]
    return found.filter(~((n_hit > 0) & (n_hit * 20 >= n_words))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each remaining document."""
    _next(spark)
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: A fitted model decides the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            done, path = path, scratch.write(docs, f"stage{k}")
            docs = spark.read.schema(docs.schema).parquet(path)
            if done:
                scratch.delete(spark, done)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
