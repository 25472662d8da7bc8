"""What op7 sends through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.llm import pstable


def vectors(spark, n):
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.rand(j) for j in range(4)]).alias("vector"))


def test_the_sample_is_that_of_the_least_hashes(spark):
    df = vectors(spark, 1500)
    want = [r.vec_id for r in df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pstable.SAMPLE).collect()]
    assert sorted(r.vec_id for r in pstable._sampled(df)) == sorted(want)
    assert pstable._sampled(df.limit(0)) == []


def test_neither_side_of_the_blocks_is_broadcast(spark, monkeypatch):
    found = []
    monkeypatch.setattr(pstable, "saved", lambda df: found.append(df) or df)
    pstable.search(vectors(spark, 300).withColumnRenamed("vector", "embedding"), F.col("vec_id") % 100 == 0)
    assert found
    found[0].collect()
    assert "Broadcast" not in found[0]._jdf.queryExecution().executedPlan().toString()
