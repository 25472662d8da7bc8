"""Lempel-Ziv phrase fingerprints.

Method: a text is parsed greedily into dictionary phrases (each the longest phrase seen before plus one character), the
set of phrases is hashed, and a one-permutation minimum-hash signature keeps the least hash in each of BINS bins. The
share of equal minima among the bins that either text fills estimates the Jaccard similarity of the phrase sets, which
behaves like a compression distance. The dictionary is closed under prefixes, so the phrase end is found by probing
around the last phrase's length instead of character by character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._hashing import Slices

BINS = 128
TASK_CHARS = 32_000_000
MOST_BLOCKS = 100_000  # whose bounds reach the driver; blocks are larger then, which takes no more memory
_EMPTY = 0xFFFF
_BITS = 7  # of the hash that choose one of the BINS


def _parse(text: str, seen: set[str], at: int) -> list[int]:
    """Parses on from ``at`` with the phrases seen so far; returns the end of each new phrase."""
    add, n, k, ends = seen.add, len(text), 4, []
    put = ends.append
    while at < n:
        phrase = text[at : at + k]
        if phrase in seen:
            while phrase in seen and at + k < n:
                k += 1
                phrase = text[at : at + k]
        else:
            while k > 1:
                shorter = text[at : at + k - 1]
                if shorter in seen:
                    break
                k -= 1
                phrase = shorter
        add(phrase)
        at += len(phrase)
        put(at)
    return ends


def _signature(text: str, ends: np.ndarray) -> np.ndarray:
    """Least 16-bit values by bin of the hashed phrases that end at ``ends``."""
    if not len(ends):
        return np.full(BINS, _EMPTY, np.uint16)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([np.zeros(1, ends.dtype), ends[:-1]])
    h = np.sort(Slices(code).hash(start, ends))
    where = (h >> np.uint64(64 - _BITS)).astype(np.intp)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    out = np.full(BINS, _EMPTY, np.uint16)
    # the least hash of a bin identifies its phrase; any 16 of its low bits will do to compare
    out[where[first]] = (h[first] & np.uint64(0xFFFF)).astype(np.uint16) % np.uint16(_EMPTY)
    return out


def parsed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The phrase ends of a whole text and its signature; an empty text fills no bin."""
    ends = np.array(_parse(text, set(), 0), np.int64)
    return ends, _signature(text, ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets, 0 to 1; two empty texts are alike."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


def edited_copy(text: str, ends: np.ndarray, following: str) -> tuple[str, np.ndarray]:
    """The edited text and its signature; the parse of the common first half is used again."""
    half = len(text) // 2
    cut = len(text) - half
    edited = text[:cut] + following[:half]
    kept = ends[: np.searchsorted(ends, cut - 1, "right")]  # a phrase that ends at the cut may now go on
    edges = [0, *kept.tolist()]
    before = {edited[i:j] for i, j in zip(edges, edges[1:], strict=False)}
    rest = _parse(edited, before, edges[-1])
    return edited, _signature(edited, np.concatenate([kept, np.array(rest, np.int64)]))


def next_in_order(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, doc_id, text, tie, carried): the rows by block of ids, each block with the row that follows its last.

    The order is doc_id descending, nulls last, equal ids by a hash of the text; the first row follows the last. Blocks
    are bounded by approximate quantiles of the ids, so ``blocks`` numbers reach the driver. The carried copy of a row
    is the head of the next block.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = rows.select("doc_id").agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] or []
    bounds = sorted(set(bounds))
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, ids.to_numpy(np.int64), "right")).astype("int32")

    # blocks count up in the order of the rows: the greatest ids are in block 0, nulls in the last
    place = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(block_of(F.coalesce("doc_id", F.lit(0))))
    keyed = rows.withColumn("block", place)
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    position = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"), F.col("doc_id").isNotNull().alias("k"), F.col("tie").alias("t"))
    heads = keyed.select("block", position.alias("p")).groupBy("block").agg(F.max("p").alias("head"))
    order = Window.orderBy("block")  # one row a block
    ring = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.col("block").alias("home"), F.coalesce(F.lag("block").over(order), F.last("block").over(ring)).alias("above"))
    placed = keyed.withColumn("head", position).join(F.broadcast(heads), "head", "left")
    return placed.select(F.explode(F.array_compact(F.array(F.struct("block", F.lit(False).alias("carried")), F.when(F.col("above").isNotNull(), F.struct(F.col("above").alias("block"), F.lit(True).alias("carried")))))).alias("at"), "doc_id", "text", "tie").select("at.block", "at.carried", "doc_id", "text", "tie")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprint of each whole text and of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document in
    the order of next_in_order. One row a row of ``docs``; null texts count as empty, a null doc_id comes last, equal ids
    follow each other by a hash of their text, and a single row follows itself. Other columns are not read. Rows stream
    through a task in order: a task holds two documents, whatever the size of a block.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // TASK_CHARS)
    blocks = blocks or max(1024, min(4 * n, MOST_BLOCKS))
    rows = next_in_order(docs, blocks).repartition(n, "block").sortWithinPartitions("block", "carried", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # block, id, text, phrase ends and signature of the row before
        for batch in batches:
            out = []
            for block, carried, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ends, own = parsed(text)
                if waiting is not None and waiting[0] == block:
                    _, before_id, before, before_ends, mark = waiting
                    edited, changed = edited_copy(before, before_ends, text)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before_id, len(before), digest, mark.tobytes().hex(), changed.tobytes().hex(), likeness(mark, changed), likeness(mark, own)))
                waiting = None if carried else (block, doc_id, text, ends, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.select("block", "carried", "doc_id", "text").mapInArrow(pair, SCHEMA)
