from __future__ import annotations

import random

import numpy as np
import pytest

from wayfold.llm import _store, omh, queries
from wayfold.llm._hashing import word_hashes
from wayfold.llm.components import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_the_edit_distance():
    r = random.Random(5)
    for _ in range(1500):
        a = [r.randint(0, 6) for _ in range(r.randint(0, 40))]
        b = list(a)
        for _ in range(r.randint(0, 9)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = [r.randint(0, 6)] * r.randint(0, 1)
        want = 1 - distance(a, b) / max(len(a), len(b), 1)
        got = omh.edit_similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert abs(got - (want if want >= 0.8 - 1e-12 else 0)) < 1e-9


def test_long_texts_are_aligned_in_a_narrow_band():
    a = np.arange(300_000, dtype=np.uint64) % np.uint64(50_000)
    b = np.concatenate([a[1:150_000], a[150_003:-1], a[:2]])
    assert 1 - 8 / 300_000 <= omh.edit_similarity(a, b) <= 1 - 3 / 300_000


def test_classes_against_all_pairs(spark, sf_dir, texts):
    got = {r.doc_id: r.class_id for r in queries.op2_order_minhash(spark, sf_dir).collect()}
    words = {k: word_hashes(t.encode())[0] for k, t in texts}
    ids = sorted(words)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if omh.edit_similarity(words[a], words[b]) >= 0.8]
    label = {k: k for k in ids}
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if v == old else v for k, v in label.items()}
    assert got == label


def test_planted_copies(spark):
    r = random.Random(1)
    base = [f"w{r.randint(0, 5000)}" for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:100] + ["new"] + base[101:])), (4, " ".join(base[:290])), (5, " ".join(f"v{r.randint(0, 5000)}" for _ in range(300))), (6, " ".join(base[150:] + base[:150]))]
    got = {x.doc_id: (x.class_id, x.class_size) for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 4), 2: (1, 4), 3: (1, 4), 4: (1, 4), 5: (5, 1), 6: (6, 1)}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in components(links).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_odd_rows(odd):
    rows = omh.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.class_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.class_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert omh.near_duplicates(odd.limit(0)).count() == 0
    kept = omh.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 5), (True, 0)]


def test_a_bucket_of_many_families_joins_each(spark, monkeypatch):
    monkeypatch.setattr(omh, "sketch", lambda words: np.arange(32, dtype=np.uint64))
    r = random.Random(7)
    rows = []
    for family in range(7):
        base = [f"f{family}w{r.randint(0, 5000)}" for _ in range(40)]
        rows += [(10 * family, " ".join(base)), (10 * family + 1, " ".join([*base[:20], "new", *base[21:]]))]
    got = {x.doc_id: x.class_id for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def edited(r, base, edits):
    out = list(base)
    for _ in range(edits):
        at, kind = r.randrange(len(out)), r.randint(0, 2)
        out[at : at + (kind > 0)] = [] if kind == 2 else [r.getrandbits(64)]
    return out


@pytest.mark.parametrize("n", [3, 10, 24, 30, 32, 120, 1000])
@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_pairs_at_the_threshold_share_a_sketch(n, similarity):
    r = random.Random(n)
    hits = wanted = 0
    for _ in range(100 if n < 1000 else 20):
        a = [r.getrandbits(64) for _ in range(n)]
        x, y = np.array(a, np.uint64), np.array(edited(r, a, int((1 - similarity) * n + 1e-9)), np.uint64)
        if omh.edit_similarity(x, y):
            wanted += 1
            hits += bool(len(np.intersect1d(omh.sketch(x), omh.sketch(y))))
    assert wanted >= 10 and hits >= 0.95 * wanted


def test_groups_are_joined_by_every_link_between_them():
    r = random.Random(9)
    base = [[r.getrandbits(64) for _ in range(30)] for _ in range(5)]
    words = [np.array(edited(r, r.choice(base), r.randint(0, 9)), np.uint64) for _ in range(120)]
    sketches = np.zeros((120, 1), np.uint64)
    for side in (np.zeros(120, int), np.arange(120) % 2):
        for labels in (np.arange(120), np.arange(120) // 2):
            want, got = list(labels), list(labels)
            links = [(i, j) for i in range(120) for j in range(i) if (side[i] != side[j] or not side.any()) and omh.edit_similarity(words[i], words[j])]
            for group, pairs in ((want, links), (got, omh.links_between(labels, words, sketches, side))):
                for i, j in pairs:
                    old, new = group[i], group[j]
                    group[:] = [new if v == old else v for v in group]
            assert len(set(want)) < len(set(labels)) and len({*zip(want, got, strict=True)}) == len(set(want)) == len(set(got))
    assert omh.links_between(np.arange(120), words, np.arange(120, dtype=np.uint64)[:, None], np.zeros(120, int)) == []


def test_a_large_bucket_goes_by_blocks(spark, monkeypatch):
    """All texts share every sketch; each family has a member that only a member other than the centre is linked with."""
    monkeypatch.setattr(omh, "sketch", lambda words: np.arange(3, dtype=np.uint64))
    monkeypatch.setattr(omh, "BLOCK", 8)
    r = random.Random(11)
    rows = []
    for family in range(9):
        base = [f"f{family}w{r.randint(0, 5000)}" for _ in range(40)]
        for step in range(4):  # a chain: neighbours differ by five words
            rows.append((10 * family + step, " ".join([*(f"new{family}x{k}" for k in range(5 * step)), *base[5 * step :]])))
    got = {x.doc_id: (x.class_id, x.class_size) for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i // 10 * 10, 4) for i, _ in rows}


def test_very_long_texts_and_ties(spark):
    long = " ".join(f"w{i % 70000}" for i in range(1_400_000))  # 9 MB
    rows = [(3, long), (1, long + " end"), (2, "x"), (2, "x"), (2, "y")]
    got = sorted((x.doc_id, x.class_id, x.class_size) for x in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (2, 2, 2), (2, 2, 2), (3, 1, 2)]


def test_intermediate_tables_are_dropped(tmp_path, documents, monkeypatch):
    monkeypatch.setattr(_store, "shared_folder", lambda spark: f"file://{tmp_path}")
    omh.near_duplicates(documents).count()
    assert len(list(tmp_path.iterdir())) == 2
