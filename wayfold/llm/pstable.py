"""Approximate nearest neighbours by multiprobe p-stable hashing.

Method: TABLES tables each hash a vector by HASHES random projections cut into slots of equal width. A query visits its
own bucket and then the perturbed buckets (one slot up or down in some projections) in the order in which they are
likely to hold neighbours: by the squared distances from the query to the slot borders it would cross. The sequence of
border sets is generated once, over the expected distances by rank; a query only ranks its own borders. The candidates
of all tables are merged and reranked by exact distance in double precision. A query that finds fewer than k ids, as one
far from the rest, is compared with all vectors.

The index is sharded: each block of vectors has its own tables, and each block of queries visits every block of vectors.
Block sizes are fixed, so tasks stay alike and there are more of them. Slot width is WIDTH times the median distance
within a sample of SAMPLE vectors, those with the least hash of the id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._store import saved

TABLES = 10
HASHES = 8
PROBES = 400
WIDTH = 1.2
SAMPLE = 512
VECTORS_A_BLOCK = 8192
QUERIES_A_BLOCK = 512
SEED = 20240229


def border_sets(hashes: int, probes: int) -> np.ndarray:
    """The most likely sets of borders to cross, as rows of zeros and ones over the 2 * hashes borders by rank.

    Ranks j and 2 * hashes - 1 - j are the two borders of one projection and never crossed together.
    """
    m, n = hashes, 2 * hashes
    near = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected = near + [1 - (n + 1 - j) / (m + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, n + 1)]
    rows, heap = [()], [(expected[0], (0,))]
    while heap and len(rows) < probes:
        cost, chosen = heapq.heappop(heap)
        if not any(n - 1 - j in chosen for j in chosen):
            rows.append(chosen)
        last = chosen[-1]
        if last + 1 < n:
            heapq.heappush(heap, (cost - expected[last] + expected[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + expected[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(rows), n), np.int64)
    for i, chosen in enumerate(rows):
        out[i, list(chosen)] = 1
    return out


class Hashing:
    """The projections of all tables, and the codes of buckets."""

    def __init__(self, dimension: int, width: float):
        rng = np.random.default_rng(SEED)
        self.width = width
        self.direction = rng.standard_normal((dimension, TABLES * HASHES))
        self.shift = rng.uniform(0, 1, TABLES * HASHES)
        self.factor = rng.integers(1, 2**62, (TABLES, HASHES), np.int64) | 1
        self.sets = border_sets(HASHES, PROBES)

    def slots(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot numbers, and the positions within the slots, by vector, table and projection."""
        place = (x @ self.direction / self.width + self.shift).reshape(len(x), TABLES, HASHES)
        low = np.floor(place)
        return low.astype(np.int64), place - low

    def codes(self, x: np.ndarray) -> np.ndarray:
        return (self.slots(x)[0] * self.factor).sum(2)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Codes of the buckets to visit, by vector and table, the likeliest first."""
        low, within = self.slots(x)
        cost = np.concatenate([within**2, (1 - within) ** 2], 2)
        step = np.concatenate([np.broadcast_to(-self.factor, low.shape), np.broadcast_to(self.factor, low.shape)], 2)
        ranked = np.take_along_axis(step, np.argsort(cost, 2, kind="stable"), 2)
        return (low * self.factor).sum(2)[:, :, None] + ranked @ self.sets.T


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _packed(rows: DataFrame, block: str, name: str) -> DataFrame:
    """(block, ids, vectors): the rows of each block in two byte strings, by id."""

    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        flat = group.column("vector").combine_chunks()
        x = flat.flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return pa.table({"block": pa.array([group.column(block)[0].as_py()], pa.int32()), f"{name}_ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), f"{name}_vectors": pa.array([x[order].astype(np.float64).tobytes()], pa.binary())})

    return rows.groupBy(block).applyInArrow(pack, f"block int, {name}_ids binary, {name}_vectors binary")


def _sampled(rows: DataFrame) -> list:
    """The SAMPLE rows of the least hash of the id, then id. Each task sends that many hashes and ids to the driver, not vectors."""
    keyed = rows.withColumn("hash", F.xxhash64("vec_id"))
    last = keyed.select("hash", "vec_id").orderBy("hash", "vec_id").limit(SAMPLE).collect()
    if not last:
        return []
    least, at = last[-1].hash, last[-1].vec_id
    return keyed.where((F.col("hash") < least) | (F.col("hash") == least) & (F.col("vec_id") <= at)).limit(SAMPLE).collect()


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found to each query, by Euclidean distance.

    ``vectors`` has vec_id and embedding. Null or zero vectors, those that hold null or non-finite components, rows
    without an id and those whose length is not the commonest take no part. Rows with the query's id are not its
    neighbours. Ties go to the smaller vec_id; a repeated row counts once. A table without usable rows gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension, count = (lengths[0].n, lengths[0]["count"]) if lengths else (1, 0)
    rows = rows.where(F.size("vector") == dimension)
    sample = _sampled(rows)
    x = np.array([r.vector for r in sample]).reshape(-1, dimension)
    apart = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))[np.triu_indices(len(x), 1)]
    typical = float(np.median(apart[apart > 0])) if (apart > 0).any() else 1.0
    shared = spark.sparkContext.broadcast(Hashing(dimension, WIDTH * typical))
    blocks = max(1, math.ceil(count / VECTORS_A_BLOCK))
    queries = rows.where(is_query)
    right = _packed(rows.withColumn("at", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")), "at", "vector")

    def visit(batches, whole):
        hashing = shared.value
        for batch in batches:
            for query_ids, query_vectors, ids, block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                query_ids, ids = np.frombuffer(query_ids, np.int64), np.frombuffer(ids, np.int64)
                q, x = np.frombuffer(query_vectors).reshape(len(query_ids), -1), np.frombuffer(block).reshape(len(ids), -1)
                codes = None if whole else hashing.codes(x)
                tables = [] if whole else [np.unique(codes[:, t], return_inverse=True) for t in range(TABLES)]
                squares = (x**2).sum(1)
                out = []
                for at in range(0, len(q), 64):
                    part = q[at : at + 64]
                    probes = None if whole else hashing.probes(part)
                    rough = (part**2).sum(1)[:, None] + squares - 2 * part @ x.T
                    for i in range(len(part)):
                        candidate = np.full(len(ids), whole)
                        for t, (buckets, member) in enumerate(tables):
                            candidate |= np.isin(buckets, probes[i, t])[member]
                        found = np.flatnonzero(candidate & (ids != query_ids[at + i]))
                        edge = np.flatnonzero(np.diff(ids[found], prepend=ids[found[0]] - 1)) if len(found) else found
                        if len(edge) > 4 * k:  # by ids, each at its nearest row
                            value = rough[i, found]
                            nearest = np.partition(np.minimum.reduceat(value, edge), 2 * k)[2 * k]
                            found = found[value <= nearest + 1e-9 * (1 + squares.max() + part[i] @ part[i])]
                        exact = np.sqrt(((x[found] - part[i]) ** 2).sum(1))
                        # by distance, then id; repeated rows of an id once
                        order = np.lexsort((ids[found], exact))
                        _, first = np.unique(ids[found][order], return_index=True)
                        order = order[np.sort(first)][:k]
                        out += [(int(query_ids[at + i]), int(ids[found[j]]), float(exact[j])) for j in order]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    def ranked(asked: DataFrame, n: int, whole: bool) -> DataFrame:
        query_blocks = max(1, math.ceil(n / QUERIES_A_BLOCK))
        left = _packed(asked.withColumn("at", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")), "at", "query")
        # merged: a broadcast of either side would go through the driver
        pairs = left.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).hint("merge").join(right, "block")
        found = pairs.select("query_ids", "query_vectors", "vector_ids", "vector_vectors").mapInArrow(lambda batches: visit(batches, whole), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    probed = saved(ranked(queries, queries.count(), False))
    enough = probed.where(F.col("rank") == k).select("query_id")
    lacking = queries.join(enough.hint("merge"), queries.vec_id == enough.query_id, "left_anti")
    n = lacking.count()
    if not n:
        return probed
    return probed.join(enough.hint("merge"), "query_id", "left_semi").select(*probed.columns).union(ranked(lacking, n, True))
