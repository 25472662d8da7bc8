from __future__ import annotations

import collections
import math
import random
import zlib

from pyspark.sql import functions as F

from wayfold.llm import contexts, ppm


def plain_log10(counts, history, symbol):
    excluded, total = set(), 0.0
    for k in range(len(history), -1, -1):
        here = counts.get(history[len(history) - k :])
        if here is None:
            continue
        seen = {s: 2 * n - 1 for s, n in here.items() if s not in excluded}
        if not seen:
            continue
        escape = len(seen) if len(seen) < 256 - len(excluded) else 0
        if symbol in seen:
            return total + math.log10(seen[symbol] / (sum(seen.values()) + escape))
        total += math.log10(escape / (sum(seen.values()) + escape))
        excluded |= set(seen)
    return total - math.log10(256 - len(excluded))


def spelled(text):
    return bytes([contexts.END] * contexts.ORDER) + ppm.lowered(text.encode()) + bytes([contexts.END])


def test_scores_are_those_of_all_contexts_and_bytes(spark, monkeypatch):
    """Over several buckets and parts; contexts count however rare, and no bytes share a class."""
    r = random.Random(3)
    letters = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x180))]
    lines = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "The cat"] * 3 + ["".join(r.choices(letters, k=200)) for _ in range(30)]
    rows = list(enumerate(lines))
    bucketed = ppm.bucketed
    monkeypatch.setattr(ppm, "bucketed", lambda x: (bucketed(x, bucket_chars=900)[0], 5))
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}
    counts: dict = collections.defaultdict(collections.Counter)
    for i, x in rows:
        s = spelled(x)
        for j in range(contexts.ORDER, len(s) if not held[i] else 0):
            for k in range(contexts.ORDER + 1):
                counts[s[j - k : j]][s[j]] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in ppm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()}
    assert len(got) == len(rows) and any(held.values())
    for i, x in rows:
        s = spelled(x)
        want = sum(plain_log10(counts, s[j - contexts.ORDER : j], s[j]) for j in range(contexts.ORDER, len(s)))
        assert math.isclose(got[i].score, want, rel_tol=1e-5)
