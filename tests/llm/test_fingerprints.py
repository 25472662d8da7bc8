from __future__ import annotations

import hashlib

from wayfold.llm import lz, queries


def plain_phrases(text):
    seen, out, at = set(), [], 0
    while at < len(text):
        k = 1
        while text[at : at + k] in seen and at + k < len(text):
            k += 1
        seen.add(text[at : at + k])
        out.append(at + len(text[at : at + k]))
        at = out[-1]
    return out


def test_parse_is_the_plain_greedy_parse(texts):
    for text in [t for _, t in texts[:60]] + ["a" * 1000, "ab" * 700, "", "x", "aab"]:
        assert lz._parse(text, set(), 0) == plain_phrases(text)


def test_query_gives_the_brute_force_rows(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op1_lz_fingerprint(spark, sf_dir).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, other = (lz.parsed(t)[1] for t in (text, edited, following))
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), changed.tobytes().hex())
        assert (r.near_edited, r.near_next) == (lz.likeness(own, changed), lz.likeness(own, other))


def test_likeness_follows_the_phrase_sets(texts):
    def phrases(t):
        ends = [0, *plain_phrases(t)]
        return {t[a:b] for a, b in zip(ends, ends[1:], strict=False)}

    errors = []
    for (_, a), (_, b) in zip(texts[:80], texts[1:81], strict=True):
        p, q = phrases(a), phrases(b)
        errors.append(abs(lz.likeness(lz.parsed(a)[1], lz.parsed(b)[1]) - len(p & q) / max(1, len(p | q))))
    assert sum(errors) / len(errors) < 0.05


def test_odd_rows(odd):
    rows = lz.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1
    assert lz.fingerprints(odd.limit(0)).count() == 0
    one = lz.fingerprints(odd.where("doc_id = 6")).first()
    assert (one.near_edited <= 1, one.near_next) == (True, 1.0)
