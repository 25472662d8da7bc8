from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.llm import html_blocks, langid, ppm, pstable, queries


def test_held_out_languages(spark, sf_dir, documents):
    got = queries.op8_language_id(spark, sf_dir)
    rows = got.join(documents.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())


def test_language_of_odd_rows(spark, odd, documents):
    model = langid.fit(documents, F.lit(True))
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count() and all((r.lang_pred == "und") == (r.doc_id in (2, 3, 4) or r.score == 0) for r in rows)
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(odd.limit(0), F.lit(True))).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0
    assert set(langid.identify(odd, model, keep=tuple(odd.columns)).columns) == {*odd.columns, "lang_pred"}


def test_many_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS", 210)
    rows = [(100 * k + i, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} " * 5, f"l{k}") for k in range(70) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert len(model.languages) == 70
    assert langid.identify(docs, model, ("doc_id", "lang")).where("lang != lang_pred").count() == 0


def test_scores_are_those_of_the_dense_kernel():
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("abcdefgh "), 60)) for _ in range(20)] + ["".join(r.choice(list("klmnopq "), 60)) for _ in range(20)]
    labels = ["x"] * 20 + ["y"] * 20
    x = langid.presence(texts)
    model = langid.Model(x, labels, landmarks=20)
    sets = [set(langid.ngram_slots(t).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    value, vector = np.linalg.eigh(kernel)
    z = np.hstack([kernel @ vector @ np.diag(value**-0.5) @ vector.T, np.ones((40, 1))])  # all rows are landmarks
    target = np.where(np.array(labels)[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    out = z @ np.linalg.solve(z.T @ z / 20 + 1e-2 / 40 * np.eye(41), z.T @ target / 20)
    power = np.exp(4 * (out - out.max(1, keepdims=True)))
    names, scores = model.predict(texts)
    assert names == [["x", "y"][k] for k in out.argmax(1)]
    assert np.allclose(scores, power.max(1) / power.sum(1), atol=1e-4)


def test_scores_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op10_ppm_score(spark, sf_dir).collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "the end"] for k, t in texts}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    c = collections.Counter(w for k, x in tokens.items() if not held[k] for w in x)
    n, v = sum(c.values()), len(c)
    for k, x in tokens.items():
        r = got[k]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(x), sum(c[w] > 0 for w in x), n)


def test_scores_of_odd_rows(odd):
    rows = ppm.score(odd, F.coalesce(F.col("doc_id"), F.lit(0)) == 6)
    assert rows.count() == odd.count()
    assert {r.n_tokens for r in rows.where("doc_id in (2, 3, 4)").collect()} == {1}
    assert ppm.score(odd.limit(0), F.lit(False)).count() == 0
    nothing = ppm.score(odd, F.lit(True)).first()
    assert (nothing.train_tokens, nothing.n_known) == (0, 0)


def test_neighbours_recall_and_distances(spark, sf_dir):
    got = queries.op7_multiprobe(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = collections.defaultdict(dict)
    for r in got:
        found[r.query_id][r.vec_id] = (r["rank"], r.score)
    hits = wanted = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(near.tolist()) & set(found[ids[i]]))
        wanted += 10
        assert all(math.isclose(s, d[np.flatnonzero(ids == k)[0]], rel_tol=1e-12) for k, (_, s) in found[ids[i]].items())
        assert sorted(r for r, _ in found[ids[i]].values()) == list(range(1, 11))
    assert hits >= 0.9 * wanted


def test_probing_sequence_is_by_expected_cost():
    sets = pstable.border_sets(3, 40)
    assert sets[0].sum() == 0 and len({tuple(r) for r in sets}) == len(sets)
    assert not any(r[j] and r[5 - j] for r in sets for j in range(3))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 2.0]), (5, [1.0, None]), (6, [1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (100, [2.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in pstable.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4, 0.0), (0, 2, 8, 0.0), (0, 3, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 4, 1.0), (100, 3, 8, 1.0)]
    assert pstable.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


PAGE = """<html><head><title>Title</title><style>p{}</style></head><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div id="cookie-notice">We use cookies and the like for all of you, so that it is nice and that was the way of it for us.</div>
<div class="sidebar"><p>The side of it is that the words of it are many and they are all of the kind that is common.</p></div>
<article><h1>Heading</h1><p>This is the main text of the article &amp; it is long enough to be decided by the stop words in it.</p><p>Short.</p>
<div class="ad">Buy the thing and be the one that is happy with it for the rest of the time in this life.</div><ul><li>one</li><li>two &lt;b&gt;</li></ul><script>var x = "<p>no</p>";</script><p>A&nbsp;final   line.</article>
<section class="comments"><p>The first comment of the reader is that it is not for all of the people and that was it.</p></section><form><label>Name</label></form><footer>&copy; 2024</footer>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Heading This is the main text of the article & it is long enough to be decided by the stop words in it. Short. one two <b> A final line."),
        (None, ""),
        ("", ""),
        ("<nav>menu</nav>", ""),
        ("<p>The text of a page with no article is in if it is long and has the words that are common to all of it.</p>", "The text of a page with no article is in if it is long and has the words that are common to all of it."),
        ('<ARTICLE><P CLASS="ad">Buy this<P>Kept</P><div role=alert>Stop</div><aside>Side</aside><header><h2>In</h2></header></ARTICLE>', "Kept In"),
        ('<div class="site-header">Top</div><main><p title="a > b">x&eacute;&nbsp;&#33;</p><br/><div id=comments><p>No</p></div>y</main>', "x\xe9 ! y"),
        ("<article>a < b and <i>c</i>d</article>", "a < b and cd"),
        ("<article>" + "<p>x" * 500, " ".join("x" * 500)),
    ],
)
def test_main_text(page, text):
    assert html_blocks.main_text(page) == text


def test_pages_keep_all_of_the_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op9_html_blocks(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        import html as h

        want = " ".join(h.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<article>x</article>"), (1, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r.page_id or 0, r.text) for r in html_blocks.extract(df).collect()) == [(0, "x"), (1, ""), (1, "")]
    assert html_blocks.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [0, 1, 10])
def test_the_sample_is_the_same_whichever_languages_are_thinned(spark, documents, monkeypatch, large):
    monkeypatch.setattr(langid, "LARGE", large)
    model = langid.fit(documents, F.lit(True), per_language=3)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    rows = documents.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    first = rows.withColumn("n", F.row_number().over(order)).where("n <= 3").orderBy("lang", "n").collect()
    assert model.languages == sorted({r.lang for r in first})
    bits = langid.presence([r.text for r in first]) > 0
    assert ((model.landmarks > 0) == bits).all()


def test_landmarks_are_bounded_in_all():
    r = np.random.default_rng(0)
    labels = [f"l{k:03d}" for k in range(300) for _ in range(3)]
    centres = r.random((300, langid.DIMENSIONS)) < 0.02
    bits = np.stack([np.where(r.random(langid.DIMENSIONS) < 0.1, r.random(langid.DIMENSIONS) < 0.02, centres[k // 3]) for k in range(900)])
    model = langid.Model(np.packbits(bits, axis=1), labels, in_all=310)
    assert len(model.landmarks) == 310 and len(model.languages) == 300
    x = bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))
    out = (x.astype(np.float32) @ model.landmarks.T).astype(np.float64) @ model.weights + model.bias
    assert (out.argmax(1) == np.repeat(np.arange(300), 3)).mean() > 0.98
    plain = langid.Model(x.astype(np.float32), labels, in_all=310)
    assert np.allclose(plain.weights, model.weights, atol=1e-3)
