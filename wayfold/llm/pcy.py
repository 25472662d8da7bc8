"""Collocations by hashed bucket counts and Apriori pruning, after PCY and DHP.

Method: the first pass counts words exactly and hashes the two-word sequences into buckets, whose counts become a bitmap.
The second counts the two-word sequences that have two frequent words and a frequent bucket, and hashes the three-word
sequences made of those; the third counts three-word sequences whose two-word parts are frequent and whose bucket is.
Every set that a pass asks about is broadcast as a bitmap of fixed size, so a pass can count too much but nothing is lost;
what is below the least count goes when the exact counts are summed. Counts are summed inside of tasks before they leave.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._bitmaps import Counters, bitmap, bucket, within
from wayfold.llm._hashing import mix
from wayfold.llm._store import Scratch

LEAST = 10
TOP = 2000
UNIT = 1_000_000
ABSORB = 50  # percent of a phrase's occurrences that lie in a longer one
CHUNK_WORDS = 2_000_000
SALTS = 256
UNKNOWN = "und"
_END = b"\xff"  # a piece's end; no UTF-8 text holds this byte
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "kind int, lang string, phrase string, n long, range int, packed binary"


class Chunk:
    """Words of one language as numbers, 0 at the ends of pieces."""

    def __init__(self, lang: str, words: list[bytes], ids: np.ndarray):
        self.lang, self.ids = lang, ids
        self.words = pa.array(words, pa.binary())
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))

    def pairs(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of known words in a row: first, second, hash, count; and the pair's number at each position, or -1."""
        inside = known[self.ids]
        at = np.flatnonzero(inside[:-1] & inside[1:])
        keys, number, counts = np.unique(self.ids[at] << 32 | self.ids[at + 1], return_inverse=True, return_counts=True)
        first, second = keys >> 32, keys & 0xFFFFFFFF
        where = np.full(len(self.ids), -1)
        where[at] = number
        return first, second, mix(self.hash[first] * _STEP + self.hash[second]), counts, where

    def triples(self, hashes: np.ndarray, kept: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words in threes both of whose pairs are kept: number of the first pair, last word, hash, count."""
        own = (where >= 0) & kept[where] if len(kept) else np.zeros(len(where), bool)
        at = np.flatnonzero(own[:-1] & own[1:])
        keys, counts = np.unique(where[at] << 32 | self.ids[at + 2], return_counts=True)
        pair, last = keys >> 32, keys & 0xFFFFFFFF
        return pair, last, mix((hashes[pair] + _STEP) * _STEP + self.hash[last]), counts

    def phrases(self, counts: np.ndarray, *ids: np.ndarray, kind: int) -> pa.RecordBatch:
        words = [self.words.take(pa.array(x)) for x in ids]
        text = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, b" ")
        return _batch(kind, [self.lang] * len(counts), text.cast(pa.string()), counts)


def _batch(kind: int, lang: list | None, phrase: pa.Array | None, n: np.ndarray, ranges: list | None = None, packed: list | None = None) -> pa.RecordBatch:
    none = [None] * len(n)
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([kind] * len(n), pa.int32()), "lang": pa.array(lang or none, pa.string()), "phrase": phrase if phrase is not None else pa.array(none, pa.string()),
        "n": pa.array(n, pa.int64()), "range": pa.array(ranges or none, pa.int32()), "packed": pa.array(packed or none, pa.binary()),
    })


def _packed(counters: Counters) -> Iterator[pa.RecordBatch]:
    for k, packed in counters.rows():
        yield _batch(0, None, None, np.zeros(1, np.int64), [k], [packed])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Of rows (lang, text): about CHUNK_WORDS words each, or one document of more."""
    vocabulary: dict[str, defaultdict] = {}
    numbers: dict[str, list[np.ndarray]] = {}
    total = 0

    def passed() -> Iterator[Chunk]:
        for lang, ids in numbers.items():
            yield Chunk(lang, list(vocabulary[lang]), np.concatenate(ids))
        vocabulary.clear()
        numbers.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            if lang not in vocabulary:
                vocabulary[lang] = known = defaultdict()
                known.default_factory = known.__len__
                known[_END]
                numbers[lang] = []
            words = text.as_py().translate(_FOLD).replace(_END, b" \xff ").split()
            words.append(_END)
            numbers[lang].append(np.fromiter(map(vocabulary[lang].__getitem__, words), np.int64, len(words)))
            total += len(words)
            if total >= CHUNK_WORDS:
                yield from passed()
                total = 0
    yield from passed()


def _pass(rows: DataFrame, work: Callable[[Chunk, Counters], Iterator[pa.RecordBatch]]) -> DataFrame:
    """One reading of the corpus: the counts that ``work`` yields and, as rows of kind 0, the buckets that it counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters()
        for chunk in chunks(batches):
            yield from work(chunk, counters)
        yield from _packed(counters)

    return rows.mapInArrow(run, _ROWS)


def _first(chunk: Chunk, counters: Counters) -> Iterator[pa.RecordBatch]:
    counts = np.bincount(chunk.ids)
    counts[0] = 0
    known = np.ones(len(counts), bool)
    known[0] = False
    at = np.flatnonzero(counts)
    yield chunk.phrases(counts[at], at, kind=1)
    _, _, hashes, n, _ = chunk.pairs(known)
    counters.add(bucket(hashes), n)


def _exact(found: DataFrame, kind: int, least: int, scratch: Scratch) -> DataFrame:
    """(lang, phrase, n) of the phrases that occur ``least`` times over the corpus."""
    return scratch.kept(found.where(F.col("kind") == kind).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _frequent(counted: DataFrame, tasks: int):
    """A bitmap of exactly counted phrases, by the hashes that chunks give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters()
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                out.append([xxhash.xxh3_64_intdigest(w, seed) for w in phrase.as_py().split(b" ")])
            words = np.array(out, np.uint64)
            if len(words):
                hashes = words[:, 0] if words.shape[1] == 1 else mix(words[:, 0] * _STEP + words[:, 1])
                counters.add(bucket(hashes), np.ones(len(words), np.int64))
        yield from _packed(counters)

    return bitmap(counted.select("lang", "phrase").mapInArrow(run, _ROWS), 1, tasks)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(UNIT * a^2 / (left * right)), by decimals of 38 digits: exact up to 10^15 occurrences."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", (a * a) * F.lit(UNIT).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's foremost phrases of two or three words.

    Null texts are empty, a null language is 'und'; every row counts, repeated ones too; other columns are ignored. Ties go
    by a, then by the bytes of the phrase. A language without phrases, as an empty table, gives no rows. Memory of a task:
    the counters (64 MB), CHUNK_WORDS words as numbers, and some 60 bytes a word of one document.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.saved(_pass(rows, _first))
        pair_buckets = bitmap(found.where("kind = 0"), least, tasks)
        total = scratch.kept(found.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total")))
        words = _exact(found, 1, least, scratch)
        frequent_words = _frequent(words, tasks)

        def second(chunk: Chunk, counters: Counters) -> Iterator[pa.RecordBatch]:
            known = within(frequent_words.value, bucket(chunk.hash))
            known[0] = False
            one, two, hashes, n, where = chunk.pairs(known)
            kept = within(pair_buckets.value, bucket(hashes))
            yield chunk.phrases(n[kept], one[kept], two[kept], kind=2)
            _, _, hashes, n = chunk.triples(hashes, kept, where)
            counters.add(bucket(hashes), n)

        found = scratch.saved(_pass(rows, second))
        triple_buckets = bitmap(found.where("kind = 0"), least, tasks)
        pairs = _exact(found, 2, least, scratch)
        frequent_pairs = _frequent(pairs, tasks)

        def third(chunk: Chunk, counters: Counters) -> Iterator[pa.RecordBatch]:
            known = within(frequent_words.value, bucket(chunk.hash))
            known[0] = False
            one, two, hashes, _, where = chunk.pairs(known)
            pair, last, triple, n = chunk.triples(hashes, within(frequent_pairs.value, bucket(hashes)), where)
            kept = within(triple_buckets.value, bucket(triple))
            yield chunk.phrases(n[kept], one[pair[kept]], two[pair[kept]], last[kept], kind=3)

        triples = _exact(_pass(rows, third), 3, least, scratch)

    def part(table: DataFrame, key: str, value: str) -> DataFrame:
        return table.select("lang", F.col("phrase").alias(key), F.col("n").alias(value))

    split = [F.element_at(F.split("phrase", " "), k).alias(f"w{k}") for k in (1, 2)]
    two = pairs.select("lang", "phrase", F.col("n").alias("a"), *split)
    inside = triples.select("lang", F.col("n").alias("longer"), F.split("phrase", " ").alias("w"))
    inside = inside.select("lang", "longer", F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    two = two.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < ABSORB * F.col("a")))
    two = two.join(part(words, "w1", "l"), ["lang", "w1"]).join(part(words, "w2", "r"), ["lang", "w2"]).select("lang", "phrase", "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))

    w = F.split("phrase", " ")
    three = triples.select("lang", "phrase", F.col("n").alias("a"), w[0].alias("w1"), w[2].alias("w3"), F.concat_ws(" ", w[0], w[1]).alias("head"), F.concat_ws(" ", w[1], w[2]).alias("tail"))
    three = three.join(part(words, "w1", "l1"), ["lang", "w1"]).join(part(words, "w3", "r2"), ["lang", "w3"]).join(part(pairs, "head", "l2"), ["lang", "head"]).join(part(pairs, "tail", "r1"), ["lang", "tail"])
    three = three.withColumns({"s1": score(F.col("a"), F.col("l1"), F.col("r1")), "s2": score(F.col("a"), F.col("l2"), F.col("r2"))})
    early = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", "a", *[F.when(early, F.col(f"{x}1")).otherwise(F.col(f"{x}2")).alias(y) for x, y in (("l", "l"), ("r", "r"), ("s", "score"))])

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    both = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


#: DuckDB SQL with the rows of the registered query.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
g AS MATERIALIZED (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, w[i:i + size - 1] AS w
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS size))),
f AS MATERIALIZED (SELECT lang, size, phrase, any_value(w) AS w, count(*) AS a FROM g GROUP BY lang, size, phrase),
n AS MATERIALIZED (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT * FROM f WHERE size > 1 AND a >= 10),
inner_ AS MATERIALIZED (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM c WHERE size = 3),
kept AS MATERIALIZED (SELECT * FROM c WHERE size = 3 OR NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.longer >= 50 * c.a)),
ends AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS cut FROM kept)),
cut AS MATERIALIZED (SELECT e.lang, e.phrase, e.a, e.cut, l.a AS l, r.a AS r, (1000000::HUGEINT * e.a * e.a) // (l.a::HUGEINT * r.a) AS score
    FROM ends e JOIN f l ON l.lang = e.lang AND l.phrase = e.head JOIN f r ON r.lang = e.lang AND r.phrase = e.tail),
low AS MATERIALIZED (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low) JOIN n USING (lang) WHERE rank <= 2000
"""
