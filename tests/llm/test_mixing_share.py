from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from wayfold.llm import mixing


def rows(spark):
    docs = [(i, f"w{i} " * 50, ("a", "b")[i % 2], "en") for i in range(2000)] + [(9999, "1 rare text", "rare", "en")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")


def test_a_rare_source_does_not_shrink_the_sample(spark):
    for share in (0.1, 0.5, 0.9):
        r = mixing.mix(rows(spark), share=share).agg(F.sum(F.col("tokens") * F.col("probability")).alias("kept"), F.sum("tokens").alias("all"), F.max("probability").alias("most")).first()
        assert abs(r.kept - share * r["all"]) < 1e-6 * r["all"] and r.most == 1


def test_the_pipeline_keeps_half(spark):
    n = corpus_pipeline.mix_sources(spark, rows(spark), "").count()
    assert 900 < n < 1100
