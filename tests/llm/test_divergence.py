from __future__ import annotations

import collections
import random
import re

from oracle import connect, same
from pyspark.sql import functions as F

from wayfold.llm import divergence, queries


def brute(rows, least=10):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in count if g == lang]
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1)]
    return sorted(out)


def found(df, **k):
    return sorted(tuple(r) for r in divergence.audit(df, **k).select("lang", "source", "part", "item", "value", "rank").collect())


def invented(seed: int, n: int = 120):
    r = random.Random(seed)
    words = ["Alpha", "beta", "Éclair", "éclair", "x1y", "don't", "ñ", "ß", "zz"]
    return [(r.choice(["en", "fr", None]), r.choice(["a", "b", "c", "Z", None]), " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for _ in range(n)] + [("de", "only", "alpha"), ("de", "empty", None)]


def test_query_against_sql(spark, sf_dir):
    same(spark, connect(sf_dir), queries.op13_source_divergence, divergence.ORACLE, sf_dir)


def test_against_plain_counts(spark, monkeypatch):
    rows = invented(1)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert found(df) == brute(rows) and found(df, least_docs=2) == brute(rows, 2)
    monkeypatch.setattr(divergence, "FLUSH", 3)
    assert found(df) == brute(rows)


def test_a_language_without_terms_has_pairs_of_zero(spark):
    got = found(spark.createDataFrame([("de", "a", "x"), ("de", "b", None), ("fr", "c", "y")], "lang string, source string, text string"))
    assert got == [("de", "a", "pair", "b", 0, 1), ("de", "b", "pair", "a", 0, 1)]


def test_ties_go_by_bytes(spark):
    rows = [("en", s, "one") for s in ("b", "a", "Z", "é") for _ in range(5)]
    got = [(i, r) for _, s, part, i, _, r in found(spark.createDataFrame(rows, "lang string, source string, text string")) if s == "b" and part == "pair"]
    assert sorted(got, key=lambda x: x[1]) == [("Z", 1), ("a", 2), ("é", 3)]


def test_odd_rows(odd):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert found(odd, least_docs=1) == brute(rows, 1)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n = 10**13 + 1
    row = spark.createDataFrame([(n, 3 * n, 7)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 2) // (3 * n + 14)


def test_a_long_text(spark):
    rows = [("en", "a", "w " * 300_000)] + [("en", s, "w v") for s in "ab" for _ in range(6)]
    assert found(spark.createDataFrame(rows, "lang string, source string, text string")) == brute(rows)
