"""Language identification with a blended-spectrum presence kernel.

Method: a text is the set of its character 1- to 3-grams (presence, not counts), hashed to DIMENSIONS slots. The kernel
of two texts is the size of the intersection over the geometric mean of the sizes. A Nystroem map from a few landmark
texts a language turns it into vectors, on which one-versus-rest kernel ridge regression is solved in closed form. A
batch of documents is then scored by two matrix products.

Fit: at most ``per_language`` labelled rows a language, those with the least hash of id and text, and fewer where there are
so many languages that all would be more than ROWS; their presence vectors (not their texts) come to the driver, a row a
language or ROWS * DIMENSIONS / 8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 8192
ROWS = 25_600
LARGE = 10_000
LANDMARKS = 1024
UNDETERMINED = "und"
_BATCH = 256


def ngram_slots(text: str) -> np.ndarray:
    """Slots of the 1-, 2- and 3-grams of the lower-cased text; repeats are left in."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    grams = [one]
    if len(code) > 1:
        grams.append(one[:-1] * np.uint64(31) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    if len(code) > 2:
        grams.append(grams[1][:-1] * np.uint64(37) + one[2:] * np.uint64(0x165667B19E3779F9))
    x = np.concatenate(grams)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - 13)).astype(np.intp)


def presence(texts: list[str]) -> np.ndarray:
    """A row of zeros and ones a text, divided by the root of its number of ones."""
    x = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        x[i, ngram_slots(text)] = 1
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Model:
    """Landmark vectors, and the weight of each landmark for each language.

    ``x``: rows of presence(), or such rows' bits (packed, 8 a byte). At most ``in_all`` landmarks are taken: the first row
    of each language, then the second, and so on to ``landmarks`` of each, so the square matrix is bounded whatever the
    number of languages; one without landmarks of its own is told by the others'. Rows are gone through in blocks.
    """

    def __init__(self, x: np.ndarray, labels: list[str], landmarks: int = 32, ridge: float = 1e-2, in_all: int = LANDMARKS):
        self.languages = sorted(set(labels))
        place = {v: k for k, v in enumerate(self.languages)}
        y = np.array([place[v] for v in labels], np.int64)
        if len(self.languages) == 0:
            self.landmarks, self.weights = np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, 0))
            return

        def rows(at: np.ndarray) -> np.ndarray:
            if x.dtype != np.uint8:
                return x[at]
            bits = np.unpackbits(x[at], axis=1).astype(np.float32)
            return bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))

        order = np.argsort(y, kind="stable")
        nth = np.empty(len(y), np.int64)
        nth[order] = np.arange(len(y)) - np.searchsorted(y[order], y[order])
        first = np.lexsort((y, nth))
        chosen = first[nth[first] < landmarks][:in_all]
        self.landmarks = rows(chosen[np.lexsort((nth[chosen], y[chosen]))])
        inner = (self.landmarks @ self.landmarks.T).astype(np.float64)
        value, vector = np.linalg.eigh(inner)
        root = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T
        size, n = np.bincount(y), len(chosen) + 1
        left, right = np.zeros((n, n)), np.zeros((n, len(self.languages)))
        for at in range(0, len(y), _BATCH):
            own = y[at : at + _BATCH]
            z = (rows(np.arange(at, at + len(own))) @ self.landmarks.T).astype(np.float64) @ root
            z = np.hstack([z, np.ones((len(z), 1))])
            weighted = (z / size[own][:, None]).T  # each language counts alike
            left += weighted @ z
            right += weighted @ np.where(own[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        solved = np.linalg.solve(left + ridge * np.eye(n) / len(chosen), right)
        self.weights, self.bias = root @ solved[:-1], solved[-1]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the soft maximum of the regression outputs."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        out = (presence(texts) @ self.landmarks.T).astype(np.float64) @ self.weights + self.bias
        power = np.exp(4 * (out - out.max(1, keepdims=True)))
        return [self.languages[k] for k in out.argmax(1)], power.max(1) / power.sum(1)


def fit(docs: DataFrame, training: Column, per_language: int = 400) -> Model:
    """Learns from rows where ``training`` holds, lang is not null and the text has a letter."""
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))  # a row a language
    per_language = max(1, min(per_language, ROWS // max(1, sizes.count())))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    # of a large language only rows that can be among the first: the share expected to hold eight times as many. The largest
    # LARGE are thus thinned before any shuffle, by 16 bytes each; each of the others has at most 1 / LARGE of the rows
    large = sizes.where(F.col("size") > 8 * per_language).groupBy(F.xxhash64("lang").alias("key")).agg(F.min("size").alias("size"))
    large = large.orderBy(F.desc("size"), "key").limit(LARGE)
    near = rows.withColumn("place", place).withColumn("key", F.xxhash64("lang")).join(F.broadcast(large), "key", "left")
    near = near.where(F.col("size").isNull() | (F.col("place") * F.col("size") <= 8 * per_language))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", F.md5("text"))
    sample = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "n", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(presence([t])[0] > 0).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["lang", "n", "bits"])

    rows = sample.mapInArrow(pack, "lang string, n int, bits binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.n))
    x = np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(-1, DIMENSIONS // 8)
    return Model(x, [r.lang for r in rows])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every row, from the whole text.

    A null text, or one without a letter, is ``und`` with score 0, as is every row if no language was learnt. Ties take
    the language first in the alphabet. Repeated rows are kept; columns that are not kept are not read, and a kept one of
    the name of a result gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    rows = docs.select(*keep, F.col("text").cast("string").alias("text_read"))
    schema = T.StructType(rows.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                b = batch.slice(at, _BATCH)
                texts = b.column(len(keep)).to_pylist()
                known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                languages, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if known:
                    found, value = shared.value.predict([texts[i] for i in known])
                    scores[known] = value
                    for i, name in zip(known, found, strict=True):
                        languages[i] = name
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(languages, pa.string()), pa.array(scores)], schema.names)

    return rows.mapInArrow(score, schema)
