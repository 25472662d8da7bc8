from __future__ import annotations

import collections
import hashlib
import random
import re

from oracle import connect, same

from wayfold.llm import _exchange, bwt_dedup, cover_dedup, queries


def by_words(docs):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for k, t in docs}
    first: dict = {}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            first.setdefault(tuple(words[k][i : i + 13]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        out[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def by_bytes(docs):
    count = collections.Counter(hashlib.md5(r[i : i + 400]).digest() for _, r in docs for i in range(len(r) - 399))
    out = []
    for k, r in docs:
        gone = bytearray(len(r))
        for i in range(len(r) - 399):
            if count[hashlib.md5(r[i : i + 400]).digest()] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(r), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_words_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_cover_dedup(spark, sf_dir).collect()}
    assert got == by_words(texts)


def test_words_against_sql(spark, sf_dir):
    same(spark, connect(sf_dir), queries.op5_cover_dedup, queries.ORACLES["op5_cover_dedup"], sf_dir)


def test_bytes_against_brute_force(spark, sf_dir, texts):
    got = sorted((tuple(r) for r in queries.op4_interval_expansion(spark, sf_dir).collect()), key=str)
    assert got == by_bytes([(k, t.encode()) for k, t in texts])


def test_random_overlaps(spark):
    r = random.Random(7)
    pool = ["".join(r.choice("abcd é") for _ in range(900)) for _ in range(4)]
    docs = []
    for k in range(40):
        parts = []
        for _ in range(r.randint(1, 4)):
            p, at = r.choice(pool), r.randint(0, 600)
            parts.append(p[at : at + r.randint(50, 700)])
        docs.append((k, "-".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for crowd in (bwt_dedup.CROWD, 2, 0):  # also with the way for crowded anchors
        got = sorted((tuple(x) for x in bwt_dedup.remove_repeats(df, crowd).drop("kept").collect()), key=str)
        assert got == by_bytes([(k, t.encode()) for k, t in docs])
    words = [(k, " ".join(w for w in re.sub("[^a-d]", " ", t).split())) for k, t in docs]
    found = cover_dedup.deduplicate(spark.createDataFrame(words, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in found} == by_words(words)


def test_many_small_parts(spark, monkeypatch):
    """On a large table a bucket sends few contexts to a part, at times only such as are repeated in full: those get no answer."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = [word(700) for _ in range(6)]
    docs = [(k, word(80) + r.choice(shared)[: r.choice((500, 600, 700))] + (word(300) if k % 2 else "")) for k in range(60)]
    docs += [(1000 + k, t) for k, t in docs[:30]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(_exchange, "PART_CHARS", 400)
    monkeypatch.setattr(_exchange.bucketed, "__defaults__", (None, 2_000))
    for crowd in (bwt_dedup.CROWD, 4):
        got = sorted((tuple(x) for x in bwt_dedup.remove_repeats(df, crowd).drop("kept").collect()), key=str)
        assert got == by_bytes([(k, t.encode()) for k, t in docs])


def test_periodic_text(spark):
    docs = [(1, "ab" * 500), (2, "x" * 399), (3, "y" * 400), (4, "z" * 401)]
    got = sorted((tuple(x) for x in bwt_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept").collect()), key=str)
    assert got == by_bytes([(k, t.encode()) for k, t in docs])


def test_what_is_left_of_a_text(spark):
    line = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, line), (2, f"  before\n{line} after"), (3, "clean  text\nstays")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in cover_dedup.deduplicate(df).collect()} == {1: line, 2: "before\nafter", 3: "clean  text\nstays"}


def test_odd_rows(odd):
    rows = cover_dedup.deduplicate(odd)
    assert set(rows.columns) == {*odd.columns, "n_words", "n_removed", "kept_sha256"}
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows.collect())
    assert got == [(0, 0, 0), (0, 3, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 14, 0), (5, 14, 0), (6, 14, 14)]
    assert cover_dedup.deduplicate(odd.limit(0)).count() == 0
    assert bwt_dedup.remove_repeats(odd).count() == odd.count()
    assert bwt_dedup.remove_repeats(odd.limit(0)).count() == 0
