from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wayfold.llm import pstable


def test_far_queries_and_repeated_rows_get_all_their_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32)
    x[100] *= 10
    x[200] *= 1000
    x[301:312] = x[300] + rng.normal(0, 1e-3, (11, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(301, x[301].tolist())] * 60
    queries = [100, 200, 300]
    got = pstable.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id").isin(queries)).collect()
    wide = x.astype(float)
    for q in queries:
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10].tolist()
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
