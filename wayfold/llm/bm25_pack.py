"""Packing documents into training windows by lexical retrieval.

Method: documents become token ids; whole windows of a document are sequences of their own, and the rest of each goes
to a pool. The pool is dealt to shards of about SHARD_TOKENS tokens, each with a BM25 inverted index over its documents
(terms are token ids; document frequencies and the mean length are those of the whole corpus). A seed document asks the
index with its QUERY_TERMS weightiest terms; its unused neighbours, best first, greedily fill the window. The last is
cut where the window ends and its rest stays in the pool, so that only the last sequence of a shard is padded.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._store import saved

WINDOW = 1024
SHARD_TOKENS = 1_000_000
QUERY_TERMS = 16
END = 0
K1, B = 1.2, 0.75
RANKS = "byte_bpe_50k.tiktoken"  # the vocabulary of byte_bpe_50k.json as ranks: the same ids, several times faster
TOKENIZER = "byte_bpe_50k.json"


@functools.cache
def encoder(ranks: str = RANKS, tokenizer: str = TOKENIZER) -> tiktoken.Encoding:
    """The vocabulary, with the added tokens of the tokenizer's file, which are found in texts too."""
    with open(public_tokenizers.path(ranks), "rb") as f:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    pairs = {piece: i for piece, i in pairs.items() if i not in added.values()}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens=added)


def token_ids(text: str) -> np.ndarray:
    """The ids of a text and the closing id."""
    return np.append(encoder().encode_to_numpy(text, allowed_special="all"), END).astype(np.uint16)


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the ids as little-endian 16-bit values, of every row; a null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                b = batch.slice(at, 512)
                ids = [token_ids(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def document_frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many documents each token occurs; at most ``vocabulary`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for ids in b.column(0):
                seen = np.zeros(vocabulary, bool)
                seen[np.frombuffer(ids.as_py(), np.uint16)] = True
                total += seen
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["token", "n"])

    rows = tokens.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[rows.column("token").to_numpy()] = rows.column("n").to_numpy()
    return out


class Index:
    """BM25 postings of a shard's documents."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, weights, owner = [], [], []
        self.queries = []
        for i, x in enumerate(ids):
            term, tf = np.unique(x, return_counts=True)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean_length))
            self.queries.append(term[np.argsort(-weight, kind="stable")[:QUERY_TERMS]])
            terms.append(term)
            weights.append(weight)
            owner.append(np.full(len(term), i))
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = np.concatenate(owner)[order], np.concatenate(weights)[order]
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.size = len(ids)

    def scores(self, i: int) -> np.ndarray:
        """Of every document of the shard for the seed's query."""
        at = np.concatenate([np.arange(self.start[t], self.start[t + 1]) for t in self.queries[i]])
        return np.bincount(self.owner[at], self.weight[at], self.size)


def fill(lengths: list[int], index: Index | None, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); ``lengths``: tokens of each document."""
    sequences = [[(i, start, window)] for i, n in enumerate(lengths) for start in range(0, n - window + 1, window)]
    start = [n - n % window for n in lengths]
    left = np.array([n % window for n in lengths], np.int64)
    unused = left > 0
    for seed in range(len(lengths)):
        while unused[seed]:
            unused[seed] = False
            sequence, space = [(seed, start[seed], int(left[seed]))], window - int(left[seed])
            score = np.where(unused, index.scores(seed), -1.0) if space else None
            while space:
                best = int(score.argmax())
                if score[best] < 0:
                    break
                n = min(space, int(left[best]))
                sequence.append((best, start[best], n))
                start[best] += n
                left[best] -= n
                unused[best] = left[best] > 0
                score[best] = -1.0
                space -= n
            sequences.append(sequence)
    return sequences


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Each id of each row lies in one piece. A null text is the closing id alone; a row with a null doc_id is packed like any
    other; repeated rows are separate documents; ties go to the lesser id. ``ids`` holds the piece's ids as
    little-endian 16-bit values. sequence_id is the shard times 2**32 plus a count within it. Whole texts are packed, however
    long; neighbours of equal score go by the order of the shard (doc_id, then a hash). Other columns are not read, and an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = saved(tokenized(docs))
    n_docs, n_tokens = tokens.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    seen = document_frequencies(tokens, encoder().max_token_value + 1)
    idf = np.log1p((n_docs - seen + 0.5) / (seen + 0.5))
    shared = spark.sparkContext.broadcast((idf, n_tokens / max(1, n_docs)))
    shards = max(1, math.ceil(n_tokens / shard_tokens))  # by tokens alone, so that the padding is the same on any cluster

    def pack_shard(group: pa.Table) -> pa.Table:
        idf, mean_length = shared.value
        group = group.take(pa.array(np.lexsort((group.column("tie").to_numpy(), group.column("doc_id").fill_null(2**63 - 1).to_numpy()))))
        ids = [np.frombuffer(x, np.uint16) for x in group.column("ids").to_pylist()]
        doc_ids, shard = group.column("doc_id").to_pylist(), group.column("shard")[0].as_py()
        out = []
        for k, sequence in enumerate(fill([len(x) for x in ids], Index(ids, idf, mean_length), window)):
            offset = 0
            for i, start, n in sequence:
                piece = ids[i][start : start + n]
                out.append((doc_ids[i], start, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids[i]), (shard << 32) + k, offset, piece.tobytes()))
                offset += n
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.table([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(names, zip(*out, strict=True), strict=True)], names)

    dealt = tokens.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("ids").alias("tie"), "doc_id", "ids")
    return dealt.groupBy("shard").applyInArrow(pack_shard, SCHEMA)
