"""Substring deduplication over words, with difference-cover anchors.

Method: {0, 1, 3} is a difference cover modulo 7: for any two positions some shift below 7 brings both to a position
that is 0, 1 or 3 modulo 7. Documents therefore hash 7-word anchors at those positions only, and any match of 13 words
holds an anchor that both sides have hashed, wherever it starts in either. Anchors that a second document has too are
then extended: the 13-word windows around them are compared by a 64-bit hash, and the least doc_id of each window found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm._exchange import bucketed, split_by_part, texts
from wayfold.llm._hashing import Slices, word_hashes

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_LAST = np.int64(2**63 - 1)  # a null id: no id is greater
_LOW = np.uint64((1 << 40) - 1)  # bits of an anchor that are sent; more anchors mean more parts, not more bits


def anchor_positions(n_words: int) -> np.ndarray:
    at = np.arange(max(0, n_words - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)] if n_words >= WINDOW else at[:0]


class _Bucket:
    """The words of a bucket's documents; everything here is the same whenever it is computed again."""

    def __init__(self, group: pa.Table, parts: int):
        self.raw = list(texts(group))
        self.parts = parts
        self.ids = group.column("doc_id").fill_null(int(_LAST)).to_numpy()
        self.bounds, self.rolls = [], []
        for raw in self.raw:
            h, start, end = word_hashes(raw)
            self.bounds.append((start, end))
            self.rolls.append(Slices(h))

    def anchors(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Distinct anchor keys by part, each document's anchors as places in them, and which keys two ids share."""
        keys = []
        for (start, _), roll in zip(self.bounds, self.rolls, strict=True):
            at = anchor_positions(len(start))
            h = roll.hash(at, at + ANCHOR)
            keys.append(((h >> np.uint64(40)) % np.uint64(self.parts)) << np.uint64(40) | h & _LOW)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        ids = np.repeat(self.ids, [len(k) for k in keys])
        least = np.full(len(distinct), _LAST)
        np.minimum.at(least, at, ids)
        shared = np.zeros(len(distinct), bool)
        shared[at[ids > least[at]]] = True
        return distinct, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), shared

    def windows(self, shared: np.ndarray, where: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Starts and hashes of each document's windows that hold a shared anchor."""
        starts, hashes = [], []
        for (start, _), roll, at in zip(self.bounds, self.rolls, where, strict=True):
            n = len(start) - WINDOW + 1
            open_ = np.zeros(max(n, 0) + PERIOD, np.int32)
            if n > 0:
                hit = anchor_positions(len(start))[shared[at]]
                np.add.at(open_, np.maximum(hit - PERIOD + 1, 0), 1)
                np.add.at(open_, np.minimum(hit + 1, n), -1)
            found = np.flatnonzero(np.cumsum(open_)[: max(n, 0)] > 0)
            starts.append(found)
            hashes.append(roll.hash(found, found + WINDOW, 1))
        return starts, hashes

    def distinct_windows(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct window hashes by part, the least id of each in the bucket, and each window's place among them."""
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        least = np.full(len(distinct), _LAST)
        np.minimum.at(least, at, np.repeat(self.ids, [len(h) for h in hashes]))
        order, _ = split_by_part(distinct, self.parts)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return distinct[order], least[order], rank[at]


def _flags(answers: pa.Table, kind: int, sizes: np.ndarray) -> np.ndarray:
    """The answers of one kind to a bucket, in the order of its questions; sizes: how many it asked each part."""
    out, start = np.zeros(int(sizes.sum()), bool), np.concatenate([[0], np.cumsum(sizes)])
    for k, part, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "bits")), strict=True):
        if k == kind:
            out[start[part] : start[part + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes[part])).astype(bool)
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """Removes each word in a 13-word window that also starts in a document with a smaller doc_id.

    Words are runs of characters other than ASCII white space, unchanged; windows are judged on the input. Returns the
    columns of ``docs``, with text replaced by what is left (as it was if nothing is removed, else without the removed
    words and the white space after them), and n_words, n_removed and kept_sha256 (of the kept words joined by one space).
    A null text is kept as null and has no words. Rows with equal ids never remove from each other; a null id counts
    as greater than any other. Columns named n_words, n_removed or kept_sha256 in the input are replaced.
    """
    added = ["n_words", "n_removed", "kept_sha256"]
    docs = docs.drop(*added)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # the other columns travel under names of their own
    wide = docs.select("doc_id", "text", *[F.col(c).alias(f"other_{i}") for i, c in enumerate(others)], F.col("text").isNull().alias("was_null"))
    dealt, parts = bucketed(wide, keep=wide.columns[2:])

    def ask_anchors(group: pa.Table) -> pa.Table:
        keys, _, shared = _Bucket(group, parts).anchors()
        bounds = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(40))
        full = np.flatnonzero(np.diff(bounds))
        low = keys.view(np.uint8).reshape(-1, 8)[:, :5]
        return pa.table({
            "part": pa.array(full, pa.int32()), "bucket": pa.array([group.column("bucket")[0].as_py()] * len(full), pa.int32()),
            "keys": pa.array([low[bounds[p] : bounds[p + 1]].tobytes() for p in full], pa.binary()),
            "shared": pa.array([np.packbits(shared[bounds[p] : bounds[p + 1]]).tobytes() for p in full], pa.binary()),
        })

    def answer_anchors(group: pa.Table) -> pa.Table:
        asked = []
        for x in group.column("keys").to_pylist():
            wide = np.zeros((len(x) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
            asked.append(wide.view(np.uint64).ravel())
        keys, at, n = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        shared = n > 1
        own = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(x)) for b, x in zip(group.column("shared").to_pylist(), asked, strict=True)]).astype(bool)
        shared[at[own]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(shared[at], np.cumsum([len(x) for x in asked])[:-1])]
        return pa.table({"kind": pa.array([0] * len(bits), pa.int32()), "bucket": group.column("bucket"), "part": group.column("part"), "bits": pa.array(bits, pa.binary())})

    def candidates(group: pa.Table, answers: pa.Table) -> tuple:
        b = _Bucket(group, parts)
        keys, where, _ = b.anchors()
        sizes = np.diff(np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(40)))
        starts, hashes = b.windows(_flags(answers, 0, sizes), where)
        return b, starts, *b.distinct_windows(hashes)

    def sizes_by_part(windows: np.ndarray) -> np.ndarray:
        return np.bincount(((windows >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), minlength=parts)

    def ask_windows(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(group):
            return pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "windows": pa.array([], pa.binary()), "least": pa.array([], pa.binary())})
        _, _, windows, least, _ = candidates(group, answers)
        bounds = np.concatenate([[0], np.cumsum(sizes_by_part(windows))])
        full = np.flatnonzero(np.diff(bounds))
        return pa.table({
            "part": pa.array(full, pa.int32()), "bucket": pa.array([group.column("bucket")[0].as_py()] * len(full), pa.int32()),
            "windows": pa.array([windows[bounds[p] : bounds[p + 1]].tobytes() for p in full], pa.binary()),
            "least": pa.array([least[bounds[p] : bounds[p + 1]].tobytes() for p in full], pa.binary()),
        })

    def answer_windows(group: pa.Table) -> pa.Table:
        asked = [np.frombuffer(x, np.uint64) for x in group.column("windows").to_pylist()]
        least = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("least").to_pylist()])
        windows, at = np.unique(np.concatenate(asked), return_inverse=True)
        first = np.full(len(windows), _LAST)
        np.minimum.at(first, at, least)
        bits = [np.packbits(x).tobytes() for x in np.split(first[at] < least, np.cumsum([len(x) for x in asked])[:-1])]
        return pa.table({"kind": pa.array([1] * len(bits), pa.int32()), "bucket": group.column("bucket"), "part": group.column("part"), "bits": pa.array(bits, pa.binary())})

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema if f.name not in ("bucket", "was_null")])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        kept, counts, gone, digests = [], [], [], []
        if len(group):
            b, starts, windows, least, rank = candidates(group, answers)
            before = _flags(answers, 1, sizes_by_part(windows))  # a smaller id in another bucket
            rank = np.split(rank, np.cumsum([len(s) for s in starts])[:-1])
            for i, (raw, (start, end)) in enumerate(zip(b.raw, b.bounds, strict=True)):
                hit = starts[i][before[rank[i]] | (least[rank[i]] < b.ids[i])]
                edge = np.zeros(len(start) + WINDOW + 1, np.int32)
                edge[hit] += 1
                edge[hit + WINDOW] -= 1
                removed = np.cumsum(edge)[: len(start)] > 0
                n = int(removed.sum())
                words = raw.split() if n == 0 else [raw[start[k] : end[k]] for k in np.flatnonzero(~removed)]
                if n:
                    stop = np.append(start[1:], len(raw))
                    flips = np.flatnonzero(np.diff(np.concatenate([[True], removed, [True]])))
                    raw = b"".join(raw[start[x] : stop[y - 1]] for x, y in zip(flips[::2], flips[1::2], strict=True))
                kept.append(raw)
                counts.append(len(start))
                gone.append(n)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        left = pa.array([None if null else x.decode("utf-8", "surrogatepass") for x, null in zip(kept, group.column("was_null").to_pylist(), strict=True)], pa.string())
        new = {"text": left, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table({f.name: new[f.name] if f.name in new else group.column(f.name) for f in schema})

    replies = "kind int, bucket int, part int, bits binary"
    by_bucket = dealt.groupBy("bucket")
    anchors = by_bucket.applyInArrow(ask_anchors, "part int, bucket int, keys binary, shared binary").groupBy("part").applyInArrow(answer_anchors, replies)
    windows = by_bucket.cogroup(anchors.groupBy("bucket")).applyInArrow(ask_windows, "part int, bucket int, windows binary, least binary").groupBy("part").applyInArrow(answer_windows, replies)
    return by_bucket.cogroup(anchors.unionByName(windows).groupBy("bucket")).applyInArrow(finish, schema).select(*[F.col(f"other_{others.index(c)}").alias(c) if c in others else F.col(c) for c in docs.columns], *added)


#: DuckDB SQL with the rows of the registered query.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS MATERIALIZED (SELECT h, min(doc_id) AS first_id FROM win GROUP BY h HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT doc_id, i FROM win JOIN least USING (h) WHERE first_id < doc_id),
gone AS MATERIALIZED (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit) GROUP BY doc_id),
word AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
out AS MATERIALIZED (SELECT doc_id, p FROM gone, unnest(g) t(p)),
kept AS MATERIALIZED (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN out USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
