from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
from oracle import connect, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfold.llm import bm25_pack, mixing, queries


def test_ids_are_those_of_the_tokenizer(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [x for _, x in texts[:80]] + ["", " ", "aé中\U0001f600 <|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|", "x" * 5000, "\n\n\n 12 it's"]:
        assert bm25_pack.token_ids(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_pieces_are_an_exact_round_trip(spark, sf_dir, texts):
    rows = queries.op3_bm25_packing(spark, sf_dir).collect()
    ids = {k: bm25_pack.token_ids(t) for k, t in texts}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(own.astype("<u4").tobytes()), len(ids[r.doc_id]))
    for k, x in ids.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 1024 - at
    assert padding <= 0.05 * 1024 * len(sequences)


def test_neighbours_share_words():
    ids = [np.array([1, 2, 3] * 100 + [0], np.uint16), np.array([7, 8, 9] * 100 + [0], np.uint16), np.array([1, 2, 4] * 100 + [0], np.uint16), np.array([7, 8, 5] * 100 + [0], np.uint16)]
    index = bm25_pack.Index(ids, np.ones(16), 301.0)
    first, second = bm25_pack.fill([len(x) for x in ids], index, 602)
    assert [d for d, _, _ in first] == [0, 2] and [d for d, _, _ in second] == [1, 3]


def test_packing_odd_rows(odd):
    rows = bm25_pack.pack(odd).collect()
    assert len({(r.doc_id, r.sequence_id, r.offset) for r in rows}) == len(rows) and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert bm25_pack.pack(odd.limit(0)).count() == 0


def test_mixing_gives_the_rows_of_its_sql(spark, sf_dir):
    same(spark, connect(sf_dir), queries.QUERIES["op6_mixing"], queries.ORACLES["op6_mixing"], sf_dir)


def test_marginals_are_met(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "q", 300), ("b", "x", "q", 500), ("b", "y", "p", 100)], "source string, lang string, topic string, tokens long")
    half = lambda c, a, b: spark.createDataFrame([(a, 0.5), (b, 0.5)], f"{c} string, target double")
    raked = mixing.rake(cells, {"source": half("source", "a", "b"), "lang": half("lang", "x", "y"), "topic": half("topic", "p", "q")}, 60)
    for margin in mixing.MARGINS:
        for r in raked.groupBy(margin).agg(F.sum("raked").alias("n")).collect():
            assert abs(r.n - 500) < 0.5


def test_sampled_share_follows_the_probabilities(documents):
    r = mixing.mix(documents).agg(F.avg("probability").alias("p"), F.avg(F.col("sampled").cast("double")).alias("s")).first()
    assert abs(r.p - r.s) < 0.12


def test_mixing_odd_rows(odd):
    rows = mixing.mix(odd)
    assert rows.count() == odd.count() and rows.where("text is null and sampled").count() == 0
    assert len({r.sampled for r in rows.where("doc_id = 5").collect()}) == 1
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.drop("source", "lang").withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))).count() == odd.count()


def test_padding_is_the_same_on_any_cluster(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = bm25_pack.pack(docs)
        found.append(sorted(tuple(r) for r in rows.drop("ids").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    used = collections.Counter()
    for r in found[0]:
        used[r[5]] += r[2]
    assert sum(1024 - n for n in used.values()) <= 0.01 * 1024 * len(used)


def test_scores_are_bm25_of_the_queries():
    r = np.random.default_rng(2)
    ids = [r.integers(1, 60, r.integers(20, 80)).astype(np.uint16) for _ in range(30)]
    idf, mean = r.random(64), 50.0
    index = bm25_pack.Index(ids, idf, mean)

    def weight(t, x):
        tf = int((x == t).sum())
        return idf[t] * tf * (bm25_pack.K1 + 1) / (tf + bm25_pack.K1 * (1 - bm25_pack.B + bm25_pack.B * len(x) / mean))

    for i, x in enumerate(ids):
        query = sorted(set(x.tolist()), key=lambda t: (-weight(t, x), t))[: bm25_pack.QUERY_TERMS]
        assert np.allclose(index.scores(i), [sum(weight(t, y) for t in query) for y in ids])


def test_raking_of_many_cells_is_that_of_few(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "q", 300), ("b", "x", "q", 500), ("b", "y", "p", 100)], "source string, lang string, topic string, tokens long")
    targets = {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}
    few = sorted(tuple(r) for r in mixing.rake(cells, targets, 2).collect())
    monkeypatch.setattr(mixing, "SMALL", 0)
    many = sorted(tuple(r) for r in mixing.rake(cells, targets, 2).collect())
    assert [r[:4] for r in few] == [r[:4] for r in many] and np.allclose([r[4] for r in few], [r[4] for r in many])
