"""Prediction by partial matching over bytes, and the word-frequency score beside it.

Method: byte contexts of order 0 to 6 are counted over all training texts. A symbol is coded at the longest context that
has seen it, after an escape from each longer one (escape method D: half a count of each distinct symbol); symbols of the
longer contexts are excluded from the shorter ones, as an escape has ruled them out. The trained model is static, so each
(context, symbol) has a fixed code length and a document's score is a sum of look-ups.

Size: no context is left out, so the counts grow with the corpus. They are never in one place: buckets of text send their
distinct grams and counts to the parts that own them, which answer with code lengths (module ``contexts``). Only grams of
two bytes and a symbol come to the driver, at most 256**3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm import contexts
from wayfold.llm._exchange import bucketed, split_by_part, texts
from wayfold.llm._hashing import word_hashes

_CHUNK = 4 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = np.uint64(0xE0D0E0D0E0D0E0D1)  # the hash that stands for the end token


def lowered(raw: bytes) -> bytes:
    return raw.translate(_LOWER)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen, at = np.unique(code, return_inverse=True)
    return seen, np.bincount(at, n, len(seen)).astype(np.int64)


def _short_grams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams of order LOCAL - 1 of the rows' texts, sorted, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, waiting, size = np.zeros(0, np.int32), np.zeros(0, np.int64), [], 0

        def settle() -> tuple[np.ndarray, np.ndarray]:
            fresh, m = np.unique(np.concatenate(waiting), return_counts=True)
            return _summed(np.concatenate([seen, fresh]), np.concatenate([n, m]))

        for b in batches:
            for value in b.column(0).cast(pa.large_binary()):
                waiting.append(contexts.of_order(contexts.grams(lowered(value.as_py())), contexts.LOCAL - 1).astype(np.int32))
                size += len(waiting[-1])
                if size >= _CHUNK:
                    seen, n = settle()
                    waiting, size = [], 0
        if waiting:
            seen, n = settle()
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n, pa.int64())], ["gram", "n"])

    # bounded by the alphabet: 256**LOCAL rows
    found = rows.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = (found.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(gram)
    return gram[order].astype(np.uint64), n[order]


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of every whole text by models trained on the rows where ``held_out`` is false.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Upper-case A-Z are lowered first. base_score
    sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the words and one end token; score is log10 of the probability of the
    bytes and the end of the text under the context model. A null text is empty: one end token. Repeated rows each count
    and are each returned; other columns are not read. Without training rows, every count is 0.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = docs.sparkSession.sparkContext.broadcast(_short_grams(rows.where(~held_out)))
    dealt, parts = bucketed(rows)
    dealt = dealt.withColumn("held_out", held_out)

    def distinct_words(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words of a bucket by part, the parts' bounds, and the place of each word of its texts."""
        words, at = np.unique(np.concatenate(each), return_inverse=True)
        order, bounds = split_by_part(words, parts)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return words[order], bounds, place[at]

    def ask(group: pa.Table) -> pa.Table:
        """The distinct words of a bucket, with their counts in its training texts."""
        held = group.column("held_out").to_numpy()
        each = [np.append(word_hashes(lowered(raw))[0], _END) for raw in texts(group)]
        words, bounds, at = distinct_words(each)
        training = np.repeat(~held, [len(x) for x in each])
        n = np.bincount(at[training], minlength=len(words))
        full = np.flatnonzero(np.diff(bounds))
        bucket = group.column("bucket")[0].as_py()
        packed = [contexts.packed(words[bounds[p] : bounds[p + 1]], n[bounds[p] : bounds[p + 1]]) for p in full]
        return pa.table({"part": pa.array(full, pa.int32()), "bucket": pa.array([bucket] * len(full), pa.int32()), "words": pa.array(packed, pa.binary())})

    def ask_grams(group: pa.Table) -> pa.Table:
        """The distinct grams of a bucket, with their counts in its training texts."""
        held = group.column("held_out").to_numpy()
        each = [contexts.grams(lowered(raw)) for raw in texts(group)]
        grams, at = np.unique(np.concatenate(each), return_inverse=True)
        n = np.bincount(at[np.repeat(~held, [len(x) for x in each])], minlength=len(grams))
        order, bounds = contexts.by_part(grams, parts)
        grams, n = grams[order], n[order]
        full = np.flatnonzero(np.diff(bounds))
        bucket = group.column("bucket")[0].as_py()
        packed = [contexts.packed(grams[bounds[p] : bounds[p + 1]], n[bounds[p] : bounds[p + 1]]) for p in full]
        return pa.table({"part": pa.array(full, pa.int32()), "bucket": pa.array([bucket] * len(full), pa.int32()), "grams": pa.array(packed, pa.binary())})

    def answer_grams(group: pa.Table) -> pa.Table:
        """The code length of each gram that each bucket asked for, by the corpus's counts."""
        asked = [contexts.unpacked(x) for x in group.column("grams").to_pylist()]
        ends = np.cumsum([len(x) for x, _ in asked])[:-1]
        grams, at = np.unique(np.concatenate([x for x, _ in asked]), return_inverse=True)
        n = np.bincount(at, np.concatenate([m for _, m in asked]), len(grams)).astype(np.int64)
        value = contexts.code_lengths(grams, grams[n > 0], n[n > 0], short.value).astype(np.float32)
        return pa.table({"bucket": group.column("bucket"), "part": group.column("part"), "values": pa.array([contexts.squeezed(x) for x in np.split(value[at], ends)], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        """The corpus's count of each word that each bucket asked for, and the part's sums on the first row."""
        asked = [contexts.unpacked(x) for x in group.column("words").to_pylist()]
        words, at = np.unique(np.concatenate([x for x, _ in asked]), return_inverse=True)
        total = np.bincount(at, np.concatenate([n for _, n in asked]), len(words)).astype(np.int64)
        ends = np.cumsum([len(x) for x, _ in asked])[:-1]
        first = np.zeros(len(asked), np.int64)
        first[0] = 1
        return pa.table({
            "bucket": group.column("bucket"), "part": group.column("part"),
            "values": pa.array([contexts.squeezed(x) for x in np.split(total[at], ends)], pa.binary()),
            "tokens": pa.array(first * total.sum()),
            "distinct": pa.array(first * (total > 0).sum()),
        })

    def in_order(answers: pa.Table, kind: str, number: type) -> np.ndarray:
        here = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("part")
        return np.concatenate([contexts.restored(x, number) for x in here.column("values").to_pylist()] or [np.zeros(0, number)])

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        raw = [lowered(x) for x in texts(group)]
        if not raw:
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        each = [np.append(word_hashes(x)[0], _END) for x in raw]
        n = np.array([len(x) for x in each])
        start = np.cumsum(n) - n
        count = in_order(answers, "words", np.int64)[distinct_words(each)[2]]
        known, base = np.add.reduceat(count > 0, start, dtype=np.int64), np.add.reduceat(np.log10(count + 0.5), start)
        each = [contexts.grams(x) for x in raw]
        grams, at = np.unique(np.concatenate(each), return_inverse=True)
        lengths = np.zeros(len(grams))
        lengths[contexts.by_part(grams, parts)[0]] = in_order(answers, "grams", np.float32)
        ppm = np.add.reduceat(lengths[at], np.cumsum([0, *(len(x) for x in each[:-1])]))
        return pa.table({"doc_id": group.column("doc_id"), "held_out": group.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(ppm)})

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
    asked = dealt.groupBy("bucket").applyInArrow(ask, "part int, bucket int, words binary")
    answered = asked.groupBy("part").applyInArrow(answer, "bucket int, part int, values binary, tokens long, distinct long")
    coded = dealt.groupBy("bucket").applyInArrow(ask_grams, "part int, bucket int, grams binary").groupBy("part").applyInArrow(answer_grams, "bucket int, part int, values binary")
    answers = answered.select(F.lit("words").alias("kind"), "bucket", "part", "values").union(coded.select(F.lit("grams"), "bucket", "part", "values"))
    scored = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    sums = answered.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "base", "score",
        sums.select("tokens").scalar().alias("train_tokens"), sums.select("distinct").scalar().alias("distinct"),
    ).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
        (F.col("base") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("distinct") + 1))).alias("base_score"), "score",
    )
