"""The corpus pipeline: stages over `documents`, each on all that the stage before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from domainsieve.llm import exact_dedup, langid, minhash, packing, paragraphs
from domainsieve.sources.workdir import new_folder, written


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without letters or far from every centroid go."""
    names = ("__lang", "__score", "__rejected")
    return langid.predict(docs, langid.learn(docs), names=names).filter("NOT __rejected").select(*_columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents whose texts differ in white space alone, and one of repeated rows."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: word shingles of five, similarity 0.8."""
    return minhash.distinct_documents(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without paragraphs and passages that earlier documents have; one left with no text goes."""
    cut = paragraphs.dedup_substrings(docs, names=("__kept", "__n", "__removed"))
    columns = dict(zip(docs.columns, _columns(docs))) | {"text": F.col("__kept")}
    same = F.col("__kept").eqNullSafe(F.col("text").cast("string"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(same, F.col("n_chars")).otherwise(
            F.length("__kept")).cast(docs.schema["n_chars"].dataType)
    return cut.filter(same | (F.col("__kept") != "")).select(*[c.alias(name) for name, c in columns.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near),
          ("substring dedup", substring), ("packing", packed)]

# Classifying, MinHash components and tokenising are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), new_folder(spark, f"stage-{name.replace(' ', '-')}"))
    return docs
