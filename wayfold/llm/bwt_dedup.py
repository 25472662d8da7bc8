"""Exact removal of repeated byte strings, by threshold-bounded interval expansion on a positional BWT.

Method: each 400-byte string is assigned to the least-hashed 40-byte anchor inside it, which its content alone decides, so
that equal strings have equal anchors at equal offsets. Neighbouring strings with one anchor form a context. Anchors
and contexts are first counted by hash: a context that occurs twice is a repeat in full, one whose anchor is unique has none.
Those left meet by anchor, aligned at it, and their common prefixes are found by backward extension: from the last column
to the first, the preceding byte of each context is prepended, intervals of contexts with equal prefixes are split by it
in order (the step of a Burrows-Wheeler transform by position), and the end of the agreement of neighbours is carried
along. All intervals grow together by one byte a step, and the expansion stops at the length of a context, 400 bytes after
its last string. A string is a repeat if a neighbour in its order agrees with it for 400 bytes.

A BWT of unaligned text needs a suffix sort of the same contexts; the alignment gives the same prefixes without one.

Contexts of an anchor that has more than CROWD different ones, as at the edge of a passage that very many documents share,
would meet in one task without a bound. Their strings are counted by hash instead, in parts by the hash of the string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._exchange import bucketed, split_by_part, texts
from wayfold.llm._hashing import Slices

LENGTH = 400
ANCHOR = 40
_REACH = LENGTH - ANCHOR  # the farthest that a string starts before its anchor
_COLUMNS = _REACH + LENGTH
CROWD = 20_000
_POSITION = 24  # bits of a position within a stretch of text
_STRETCH = 1 << 22  # starts that are looked at together


def sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Of each ``width`` neighbours, by blocks with running minima from both ends."""
    n = len(v) - width + 1
    p = np.full(-(-len(v) // width) * width, np.uint64(2**64 - 1))
    p[: len(v)] = v
    p = p.reshape(-1, width)
    ahead = np.minimum.accumulate(p, 1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(raw: bytes) -> tuple[np.ndarray, ...]:
    """First start, end of starts and anchor position of each context of a text, and hashes of anchor and context."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    s = Slices(np.frombuffer(raw, np.uint8))
    h = s.windows(ANCHOR)
    mask = np.uint64((1 << _POSITION) - 1)
    firsts, ends, anchors = [], [], []
    for at in range(0, n, _STRETCH):
        stop = min(n, at + _STRETCH)
        part = h[at : stop + _REACH]
        least = sliding_minimum(part & ~mask | np.arange(len(part), dtype=np.uint64), _REACH + 1) & mask
        edge = np.flatnonzero(np.diff(least.astype(np.int64), prepend=-1))
        firsts.append(at + edge)
        ends.append(at + np.append(edge[1:], len(least)))
        anchors.append(at + least[edge].astype(np.int64))
    first, end, anchor = np.concatenate(firsts), np.concatenate(ends), np.concatenate(anchors)
    return first, end, anchor, s.hash(anchor, anchor + ANCHOR), s.hash(first, end - 1 + LENGTH, 3)


def repeats(group: np.ndarray, text: np.ndarray, offset: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether each string of some contexts is also in another context of its group, in the order of the contexts.

    ``text`` holds the contexts one after the other, at ``offset``, of ``length`` bytes; ``before``: how far each starts
    before its anchor. Contexts come by group.
    """
    m = len(group)
    low = _REACH - before  # the columns of a context
    high = low + length
    starts = length - LENGTH + 1
    place = np.concatenate([[0], np.cumsum(starts)])
    found = np.zeros(place[-1], bool)
    head = np.flatnonzero(np.diff(group.astype(np.int64), prepend=group[0].astype(np.int64) - 1 if m else 0)) if m else np.zeros(0, np.int64)
    is_head = np.zeros(m + 1, bool)
    is_head[head] = is_head[m] = True
    number = np.cumsum(is_head[:m]) - 1
    size = np.diff(np.append(head, m))
    order = np.arange(m)
    agree = np.full(m + 1, _COLUMNS)  # first column where a context differs from the one before it
    agree[is_head] = -1
    base = offset - low
    for j in range(_COLUMNS - 1, -1, -1):
        valid = (low <= j) & (j < high)
        byte = np.full(m, 256, np.int64)
        byte[valid] = text[base[valid] + j]
        c = byte[order]
        changed = np.flatnonzero((c[1:] != c[:-1]) & ~is_head[1:m])
        if len(changed):
            mixed = np.unique(number[changed])
            width = size[mixed]
            sub = np.repeat(head[mixed] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            key = number[sub] << 9 | c[sub]
            turn = np.argsort(key, kind="stable")
            old, sorted_key = sub[turn], key[turn]
            same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
            fresh = np.full(len(sub), j)
            ranges = np.empty(2 * len(same), np.int64)
            ranges[::2], ranges[1::2] = old[same - 1] + 1, old[same] + 1
            if len(same):
                fresh[same] = np.minimum.reduceat(agree, ranges)[::2]
            fresh[is_head[sub]] = -1
            agree[sub] = fresh
            order[sub] = order[old]
        if j <= _REACH:
            enough = agree >= j + LENGTH
            if enough.any():
                hit = order[enough[:m] | enough[1:]]
                hit = hit[(low[hit] <= j) & (j - low[hit] < starts[hit])]
                found[place[hit] + j - low[hit]] = True
    return found


class _Bucket:
    """The contexts of a bucket's documents, distinct and in the order of the parts; the same whenever computed again."""

    def __init__(self, group: pa.Table, parts: int):
        self.raw, self.parts = list(texts(group)), parts
        each = [contexts(raw) for raw in self.raw]
        self.count = [len(e[0]) for e in each]
        self.first, self.end, self.anchor, anchor, context = (np.concatenate([e[k] for e in each]) for k in range(5))
        self.document = np.repeat(np.arange(len(self.raw)), self.count)
        part = (anchor >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((np.arange(len(part)), context, anchor, part))
        a, c = anchor[order], context[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.one = order[fresh]  # a context of each kind
        self.anchors, self.contexts = a[fresh], c[fresh]
        self.several = np.diff(np.append(np.flatnonzero(fresh), len(order))) > 1
        self.kind = np.empty(len(order), np.int64)  # of each context
        self.kind[order] = np.cumsum(fresh) - 1
        self.bounds = np.searchsorted(part[order][fresh], np.arange(parts + 1, dtype=np.uint64))

    def pieces(self, wanted: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text, length and distance to the anchor of one context of each wanted kind."""
        at = self.one[wanted]
        text = [self.raw[self.document[i]][self.first[i] : self.end[i] - 1 + LENGTH] for i in at]
        return b"".join(text), (self.end[at] - self.first[at] - 1 + LENGTH).astype(np.uint32), (self.anchor[at] - self.first[at]).astype(np.uint32)

    def strings(self, kinds: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct hashes of the strings of some kinds by part, which occur twice, the parts' bounds, and places by kind."""
        hashes, at = [], None
        for k in kinds.tolist():
            i = self.one[k]
            if at != self.document[i]:
                at = self.document[i]
                slices = Slices(np.frombuffer(self.raw[at], np.uint8))
            start = np.arange(self.first[i], self.end[i])
            hashes.append(slices.hash(start, start + LENGTH, 5))
        distinct, place, n = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        several = n > 1
        sizes = [len(h) for h in hashes]
        several[place[np.repeat(repeated[kinds], sizes)]] = True
        order, bounds = split_by_part(distinct, self.parts)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return distinct[order], several[order], bounds, _cut(rank[place], sizes)


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _cut(values: np.ndarray, sizes: np.ndarray | list[int]) -> list[np.ndarray]:
    """Consecutive pieces of these sizes; none for no sizes, where np.split() would give an empty one."""
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _answers(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {p: b for k, p, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "bits")), strict=True) if k == kind}


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Removes each byte covered by a 400-byte string that also starts anywhere else, in the same document or another.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left) and kept_sha256, a row for each row
    of ``docs``. Texts are taken as UTF-8; strings are judged on the input and never run across documents; a null text
    is empty. Repeated rows are each other's repeats. Null ids are kept; other columns are not read.
    """
    dealt, parts = bucketed(docs)

    def ask_kinds(group: pa.Table) -> pa.Table:
        b = _Bucket(group, parts)
        full = np.flatnonzero(np.diff(b.bounds))
        cut = lambda x: pa.array([x[b.bounds[p] : b.bounds[p + 1]].tobytes() for p in full], pa.binary())
        return pa.table({
            "part": pa.array(full, pa.int32()), "bucket": pa.array([group.column("bucket")[0].as_py()] * len(full), pa.int32()),
            "anchors": cut(b.anchors), "contexts": cut(b.contexts),
            "several": pa.array([np.packbits(b.several[b.bounds[p] : b.bounds[p + 1]]).tobytes() for p in full], pa.binary()),
        })

    def answer_kinds(group: pa.Table) -> pa.Table:
        """For each kind: whether it occurs twice, whether this bucket shall send its text, or else its strings."""
        group = group.sort_by("bucket")
        anchors = [np.frombuffer(x, np.uint64) for x in group.column("anchors").to_pylist()]
        sizes = [len(x) for x in anchors]
        a, c = np.concatenate(anchors), np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("contexts").to_pylist()])
        several = np.concatenate([_bits(x, n) for x, n in zip(group.column("several").to_pylist(), sizes, strict=True)])
        order = np.lexsort((np.arange(len(a)), c, a))
        new_anchor = np.ones(len(order), bool)
        new_anchor[1:] = a[order][1:] != a[order][:-1]
        fresh = new_anchor.copy()
        fresh[1:] |= c[order][1:] != c[order][:-1]
        at = np.flatnonzero(fresh)
        twice = np.logical_or.reduceat(several[order], at) | (np.diff(np.append(at, len(order))) > 1)
        anchor_of = np.cumsum(new_anchor) - 1
        different = np.bincount(anchor_of[at])[anchor_of]  # contexts of the anchor
        flags = np.zeros((3, len(a)), bool)
        flags[0, order] = twice[np.cumsum(fresh) - 1]
        flags[1, order] = fresh & (different > 1) & (different <= crowd)
        flags[2, order] = different > crowd
        bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1], axis=1)]
        return pa.table({"kind": pa.array([0] * len(bits), pa.int32()), "bucket": group.column("bucket"), "part": group.column("part"), "bits": pa.array(bits, pa.binary())})

    def verdicts(b: _Bucket, answers: pa.Table) -> np.ndarray:
        flags = np.zeros((3, len(b.one)), bool)
        for p, blob in _answers(answers, 0).items():
            low, high = b.bounds[p], b.bounds[p + 1]
            flags[:, low:high] = _bits(blob, 3 * (high - low)).reshape(3, -1)
        return flags

    ASK = "kind int, part int, bucket int, anchors binary, open binary, lengths binary, before binary, text binary"

    def ask_texts(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(group):
            b = _Bucket(group, parts)
            repeated, send, many = verdicts(b, answers)
            bucket = group.column("bucket")[0].as_py()
            for p in np.flatnonzero(np.diff(b.bounds)):
                wanted = b.bounds[p] + np.flatnonzero(send[b.bounds[p] : b.bounds[p + 1]])
                if len(wanted):
                    text, length, before = b.pieces(wanted)
                    rows.append((1, int(p), bucket, b.anchors[wanted].tobytes(), np.packbits(~repeated[wanted]).tobytes(), length.tobytes(), before.tobytes(), text))
            strings, several, bounds, _ = b.strings(np.flatnonzero(many), repeated)
            for p in np.flatnonzero(np.diff(bounds)):
                here = slice(bounds[p], bounds[p + 1])
                rows.append((2, int(p), bucket, strings[here].tobytes(), np.packbits(several[here]).tobytes(), b"", b"", b""))
        kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5)
        names = [x.split()[0] for x in ASK.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    def answer_texts(group: pa.Table) -> pa.Table:
        """For each context that occurs once: which of its strings another context of its anchor has."""
        lengths = [np.frombuffer(x, np.uint32).astype(np.int64) for x in group.column("lengths").to_pylist()]
        length = np.concatenate(lengths)
        anchor = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("anchors").to_pylist()])
        before = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("before").to_pylist()]).astype(np.int64)
        open_ = np.concatenate([_bits(x, len(n)) for x, n in zip(group.column("open").to_pylist(), lengths, strict=True)])
        text = np.frombuffer(b"".join(group.column("text").to_pylist()), np.uint8)
        offset = np.cumsum(length) - length
        order = np.argsort(anchor, kind="stable")
        found = repeats(anchor[order], text, offset[order], length[order], before[order])
        starts = length[order] - LENGTH + 1
        split = dict(zip(order.tolist(), _cut(found, starts), strict=True))
        bits, at = [], 0
        for n in map(len, lengths):
            own = [split[i] for i in range(at, at + n) if open_[i]]
            bits.append(np.packbits(np.concatenate(own)).tobytes() if own else b"")
            at += n
        return pa.table({"kind": pa.array([1] * len(bits), pa.int32()), "bucket": group.column("bucket"), "part": group.column("part"), "bits": pa.array(bits, pa.binary())})

    def answer_strings(group: pa.Table) -> pa.Table:
        """Which strings occur twice."""
        asked = [np.frombuffer(x, np.uint64) for x in group.column("anchors").to_pylist()]
        distinct, at, n = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        twice = n > 1
        twice[at[np.concatenate([_bits(x, len(y)) for x, y in zip(group.column("open").to_pylist(), asked, strict=True)])]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(twice[at], np.cumsum([len(x) for x in asked])[:-1])]
        return pa.table({"kind": pa.array([2] * len(bits), pa.int32()), "bucket": group.column("bucket"), "part": group.column("part"), "bits": pa.array(bits, pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        return answer_texts(group) if group.column("kind")[0].as_py() == 1 else answer_strings(group)

    RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(group):
            b = _Bucket(group, parts)
            repeated, send, many = verdicts(b, answers)
            marks: dict[int, np.ndarray] = {}
            for p, blob in _answers(answers, 1).items():
                single = b.bounds[p] + np.flatnonzero((send & ~repeated)[b.bounds[p] : b.bounds[p + 1]])
                starts = (b.end - b.first)[b.one[single]]
                marks.update(zip(single.tolist(), _cut(_bits(blob, int(starts.sum())), starts), strict=True))
            if many.any():
                crowded = np.flatnonzero(many)
                strings, _, bounds, places = b.strings(crowded, repeated)
                twice = np.zeros(len(strings), bool)
                for p, blob in _answers(answers, 2).items():
                    twice[bounds[p] : bounds[p + 1]] = _bits(blob, bounds[p + 1] - bounds[p])
                marks.update(zip(crowded.tolist(), [twice[x] for x in places], strict=True))
            at = 0
            for doc_id, raw, count in zip(group.column("doc_id").to_pylist(), b.raw, b.count, strict=True):
                edge = np.zeros(len(raw) + 1, np.int32)
                for i in range(at, at + count):
                    kind = b.kind[i]
                    if repeated[kind]:
                        edge[b.first[i]] += 1
                        edge[b.end[i] - 1 + LENGTH] -= 1
                    elif kind in marks:
                        s = b.first[i] + np.flatnonzero(marks[kind])
                        edge[s] += 1
                        edge[s + LENGTH] -= 1
                at += count
                gone = np.cumsum(edge[:-1]) > 0
                n = int(gone.sum())
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if n else 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if n else raw
                rows.append((doc_id, len(raw), n, spans, kept, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    replies = "kind int, bucket int, part int, bits binary"
    by_bucket = dealt.groupBy("bucket")
    kinds = by_bucket.applyInArrow(ask_kinds, "part int, bucket int, anchors binary, contexts binary, several binary").groupBy("part").applyInArrow(answer_kinds, replies)
    strings = by_bucket.cogroup(kinds.groupBy("bucket")).applyInArrow(ask_texts, ASK).groupBy("kind", "part").applyInArrow(answer, replies)
    return by_bucket.cogroup(kinds.unionByName(strings).groupBy("bucket")).applyInArrow(finish, RESULT)
