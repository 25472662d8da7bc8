from __future__ import annotations

import collections
import random
import re

import numpy as np
from oracle import connect, same
from pyspark.sql import functions as F

from wayfold.llm import _bitmaps, pcy, queries


def brute(rows, least=10, top=2000):
    """The phrases of (lang, text) rows, counted plainly."""
    counts: dict = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cands.items():
            longer = [b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def found(df, **k):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in pcy.collocations(df, **k).collect())


def invented(seed: int, n: int = 60):
    r = random.Random(seed)
    words = ["New", "york", "Éa", "x1", "the", "of", "ab", "cd", "ef"]
    mark = lambda: r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " - "])
    return [(r.choice(["en", "fr", None]), "".join(r.choice(words) + mark() for _ in range(r.randint(0, 80)))) for _ in range(n)]


def test_query_against_sql(spark, sf_dir):
    same(spark, connect(sf_dir), queries.op12_pcy_collocations, pcy.ORACLE, sf_dir)


def test_against_plain_counts(spark):
    rows = invented(1)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert found(df) == brute(rows)
    assert found(df, least=3, top=5) == brute(rows, 3, 5)


def test_bitmaps_sum_the_counts_of_tasks(spark):
    rows = []
    for task in range(3):
        counters = _bitmaps.Counters()
        counters.add(np.array([5, 70_000, 5, 9, _bitmaps.BUCKETS - 1]), np.array([2, 1, 2, 3 - task, 1000]))
        counters.add(np.array([70_000]), np.array([2]))
        rows += list(counters.rows())
    bits = _bitmaps.bitmap(spark.createDataFrame(rows, "range int, packed binary"), 9, 4).value
    assert _bitmaps.within(bits, np.array([5, 70_000, 9, 10, _bitmaps.BUCKETS - 1])).tolist() == [True, True, False, False, True]
    assert not _bitmaps.bitmap(spark.createDataFrame([], "range int, packed binary"), 1, 4).value.any()


def test_odd_rows(spark, odd):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert found(odd, least=1) == brute(rows, 1)
    assert pcy.collocations(odd.limit(0)).count() == 0 and found(odd) == []


def test_a_long_text_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(pcy, "CHUNK_WORDS", 1000)
    rows = [("en", "a b c d. " * 30_000), ("en", "a b"), ("en", "a b")]
    got = found(spark.createDataFrame(rows, "lang string, text string"))
    assert got == brute(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**12 + 7
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").select(pcy.score(*(F.col(c) for c in "alr")).alias("s")).first()
    assert row.s == 1_000_000 * big * big // ((big + 1) * (big + 2))
