"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bm25_pack, bwt_dedup, cover_dedup, divergence, html_blocks, jaccard_join, langid, lz, mixing, omh, pcy, ppm, pstable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n; the fold of a document. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_pack.pack(table(spark, sf_dir, "documents")).drop("ids")


def op4_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.coalesce("source", F.lit(mixing.UNKNOWN)).alias("source"), F.coalesce("lang", F.lit(mixing.UNKNOWN)).alias("lang"), "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op7_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, remainder(3) != 1))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.fingerprints(table(spark, sf_dir, "documents"))


def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op10_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), remainder(5) == 1)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op12_pcy_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcy.collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lz_fingerprint": op1_lz_fingerprint,
    "op2_order_minhash": op2_order_minhash,
    "op3_bm25_packing": op3_bm25_packing,
    "op4_interval_expansion": op4_interval_expansion,
    "op5_cover_dedup": op5_cover_dedup,
    "op6_mixing": op6_mixing,
    "op7_multiprobe": op7_multiprobe,
    "op8_language_id": op8_language_id,
    "op9_html_blocks": op9_html_blocks,
    "op10_ppm_score": op10_ppm_score,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_pcy_collocations": op12_pcy_collocations,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op5_cover_dedup": cover_dedup.ORACLE,
    "op6_mixing": mixing.oracle(),
    "op12_pcy_collocations": pcy.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
