"""Corpus preparation: documents go through the stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bm25_pack, cover_dedup, langid, mixing, omh
from wayfold.llm._store import saved
from wayfold.llm.queries import remainder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go; a missing lang is filled in."""
    found = langid.identify(docs, langid.fit(docs, remainder(3) != 1), keep=tuple(docs.columns))
    kept = found.where(F.col("lang_pred") != langid.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return omh.one_of_each(docs)


def remove_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that an earlier document has go; so does a document of which nothing is left."""
    left = cover_dedup.deduplicate(docs).where("n_words = 0 OR n_removed < n_words")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities, half of the tokens."""
    return mixing.mix(docs, share=0.5).where("sampled").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, by piece."""
    return bm25_pack.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_shared_passages),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Language prediction, edit similarity and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
