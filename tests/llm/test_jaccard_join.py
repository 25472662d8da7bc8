from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wayfold.llm import jaccard_join as jj
from wayfold.llm import queries


def sets_of(docs):
    out = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[k] = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    return out


def brute(docs):
    """n_shingles and component of each document, all pairs compared."""
    sets = sets_of(docs)
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k)) for k in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join(df).collect()}


def families(seed: int):
    r = random.Random(seed)
    docs = []
    for _ in range(20):
        n = r.choice([9, 10, 11, 13, 14, 21, 22, 50, 120, 400])
        base = [f"w{r.randint(0, 3000)}" for _ in range(n + 2)]
        rate = r.choice([0.01, 0.02, 0.035, 0.05])
        for _ in range(r.choice([2, 5, 30])):
            w = list(base)
            for _ in range(r.randint(0, max(1, int(n * rate)))):
                i, o = r.randrange(len(w)), r.random()
                if o < 0.5:
                    w[i] = f"x{r.randint(0, 10**6)}"
                elif o < 0.75:
                    w.insert(i, "Y")
                else:
                    del w[i]
            docs.append((len(docs) * 3 + 1, " ".join(w)))
    return docs


def test_query_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op11_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("block", [jj.BLOCK, 8])
def test_no_link_is_lost_in_families(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    docs = families(block)
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute(docs)


def test_a_hot_centre_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jj, "DEGREE", 3)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(1, 40)] + [(0, " ".join(base))]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_short_and_odd_rows(spark, odd):
    docs = [(5, ""), (6, None), (7, "a"), (8, "A"), (9, "a b"), (10, "a\tB"), (11, "a b c"), (12, " \n"), (3, "a b c")]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
    rows = jj.join(odd)
    assert rows.columns == ["doc_id", "n_shingles", "component_id"] and rows.count() == odd.count()
    assert [(r.n_shingles, r.component_id) for r in rows.where("doc_id IS NULL").orderBy("n_shingles").collect()] == [(0, None), (1, None)]
    assert {(r.doc_id, r.component_id) for r in rows.where("doc_id > 4").collect()} == {(5, 5), (6, 5)}
    assert jj.join(odd.limit(0)).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{i % 5000}v{i}" for i in range(150_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-4000] + ["x"] * 4000)), (3, " ".join(words[:100_000]))]
    got = found(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {k: c for k, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3} and got[1][0] == 149_998


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(1)
    for n in (9, 10, 13, 14, 15, 21, 40, 100, 700):
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            apart = 2 * len(a) // jj.APART  # as far apart as a link allows: half is replaced
            b = np.unique(np.concatenate([r.permutation(a)[apart // 2 :], r.integers(0, 2**63, apart // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert len(np.intersect1d(jj.signatures(a), jj.signatures(b)))


def test_sketches_never_exceed_the_difference():
    r = np.random.default_rng(2)
    for n, m in ((10, 11), (500, 480), (1000, 1100)):
        a, b = (np.unique(r.integers(0, 2**63, k).astype(np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate([a[: n // 2], b]))
        x, y = (np.frombuffer(jj.sketch(z), np.uint64)[None, :] for z in (a, b))
        least = min(x.shape[1], y.shape[1])
        apart = int(np.bitwise_count(jj._folded(x, least) ^ jj._folded(y, least)).sum())
        assert 0 < apart <= len(np.setxor1d(a, b))


def test_a_forest_joins_what_its_edges_join(monkeypatch):
    sets = [np.arange(k, k + 100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (0, 2, 4, 6, 50)]
    rows = {"side": [0] * 5, "node": [1, 2, 3, 4, 5], "class": [1, 2, 3, 4, 5], "size": [100] * 5, "sketch": [jj.sketch(np.sort(s)) for s in sets]}
    group = pa.table({k: pa.array(v, pa.binary()) if k == "sketch" else pa.array(v, pa.int64()) for k, v in rows.items()})
    pairs = lambda forest: sorted(zip(*(jj._near(group, forest).column(c).to_pylist() for c in "ab"), strict=True))
    assert pairs(False) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)] and pairs(True) == [(1, 2), (2, 3), (3, 4)]
    monkeypatch.setattr(jj, "EDGES", 0)
    assert pairs(True) == [(1, 2), (2, 3), (3, 4)]
