from __future__ import annotations

import corpus_pipeline
from wayfold.llm import bm25_pack
from wayfold.llm._store import saved


def test_stages_take_effect(spark, sf_dir, documents):
    docs, kept = documents, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        kept[name] = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
    ids = {r.doc_id: bm25_pack.token_ids(r.text or "") for r in before.collect()}
    assert sum(r.length for r in docs.collect()) == sum(len(x) for x in ids.values())
    assert documents.count() >= kept["language_id"] > kept["near_dedup"] >= kept["substring_dedup"] > kept["mixing"] > 0


def test_run_gives_the_rows_of_the_stages(spark, sf_dir):
    a, b = (sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and a


def test_stages_take_odd_rows(spark, odd, sf_dir):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf_dir)
        assert name == "packing" or rows.columns == docs.columns
        ids[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in rows.collect())
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    # those without a letter go; one of each group stays; the words of 6 are those of 5; every row has a piece
    assert ids["language_id"] == [-1, 5, 5, 6]
    assert ids["near_dedup"] == [-1, 2, 5]
    assert ids["substring_dedup"] == [-1, -1, 2, 3, 4, 5, 5]
    assert set(ids["mixing"]) <= {-1, 5, 6}
    assert ids["packing"] == [-1, -1, 2, 3, 4, 5, 5, 6]
