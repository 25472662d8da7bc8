"""Near-duplicate groups by Order MinHash.

Method: a text is the sequence of its k-mers of words, each labelled with its occurrence so that repeats differ. Each of
SKETCHES hash functions picks the TUPLE least labelled k-mers, and the sketch is their hash in the order in which they
stand in the text, so that equal sketches tell of a small edit distance and not merely of common k-mers. Two texts with an
equal sketch are candidates, and linked if their banded word alignment gives an edit similarity of at least 0.8.

k-mers are of two words: at an edit similarity of 0.8 nearly half of the union of two texts' two-word k-mers is common, but
only a fifth of the five-word ones. Texts of a few words have k-mers of one word; those of MIDDLE lengths have both, so
that two texts whose lengths allow a link always share a kind.

Not every candidate pair is aligned, yet no link is lost: first each text is compared with the centre of each of its
buckets, so that a bucket of n texts gives n - 1 pairs, and the links give groups. Texts with a common centre that are not
one group then meet in pairs of blocks of about BLOCK texts, where those with an equal sketch are aligned, unless a bound
(lengths, and counts of words by BINS hashed bins) rules a link out or their groups are joined by then. Pairs stay in the
task; only links leave it. Texts of a large family that belong to none of its groups are thus compared with much of it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._hashing import Slices, mix, word_hashes
from wayfold.llm._store import Scratch
from wayfold.llm.components import components

SKETCHES = 40
TUPLE = 3
MIDDLE = (24, 32)  # words: shorter texts have k-mers of one word, longer ones of two; the ratio is beyond 1 / SIMILARITY
SIMILARITY = 0.8
BINS = 64
BLOCK = 1024
_ROWS = 1024
_FACTORS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def _sketch(words: np.ndarray, k: int) -> np.ndarray:
    """SKETCHES hashes of a sequence of word hashes by its k-mers; a text of fewer words is one k-mer."""
    x = Slices(words).windows(k) if len(words) >= k else Slices(words).hash(np.zeros(1, np.int64), np.array([len(words)]))
    order = np.argsort(x, kind="stable")
    s = x[order]
    n = np.arange(len(s))
    label = n - np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), n, 0))
    x = np.empty_like(s)
    x[order] = mix(s + label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), k)
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 21) // len(x))
    for at in range(0, SKETCHES, step):
        h = x[None, :] * _FACTORS[at : at + step, None]
        rows, picks = np.arange(len(h)), []
        for _ in range(min(TUPLE, len(x))):
            i = h.argmin(1)
            h[rows, i] = np.uint64(2**64 - 1)
            picks.append(i)
        value = mix(np.arange(at, at + len(h), dtype=np.uint64), 7)
        for i in np.sort(np.stack(picks), 0):
            value = mix(value * np.uint64(31) + x[i])
        out[at : at + step] = value
    return out


def sketch(words: np.ndarray) -> np.ndarray:
    """The sketches of a sequence of word hashes: SKETCHES of each kind of k-mer that its length calls for."""
    kinds = [k for k, wanted in ((1, len(words) < MIDDLE[1]), (2, len(words) >= MIDDLE[0])) if wanted]
    return np.concatenate([_sketch(words, k) for k in kinds])


def bins(words: np.ndarray) -> np.ndarray:
    """How many words fall into each bin."""
    return np.bincount((words >> np.uint64(58)).astype(np.intp), minlength=BINS)


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - distance / length of the longer, over words; 0 if it is below ``least``.

    Only cells within the distance allowed of the main diagonal (a band) are computed, a column at a time, as the bits of
    integers: each bit tells whether a cell is one more or one less than the cell above it. Cells outside of the band
    count as one more than their neighbours inside, which cannot lead to a distance within the band. The band begins narrow and
    is widened up to the distance allowed, so that long texts that are nearly the same take little.
    """
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    allowed = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > allowed:
        return 0.0
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))).sum()
    if longer - common > allowed:  # an alignment leaves at least the words that the other lacks
        return 0.0
    x, y = at[: len(a)], at[len(a) :]
    for _ in range(2):  # an alignment may keep the words that both begin or end with
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        same = int(differ[0]) if len(differ) else n
        x, y = x[same:][::-1], y[same:][::-1]
    rows, columns, band = x.tolist(), y.tolist(), min(32, allowed)
    while (distance := _banded(rows, columns, band)) is None:
        if band == allowed:
            return 0.0
        band = min(4 * band, allowed)
    return 1 - distance / longer


def _banded(rows: list[int], columns: list[int], allowed: int) -> int | None:
    """The edit distance of two sequences if it is at most ``allowed``."""
    gap = len(rows) - len(columns)
    if abs(gap) > allowed:
        return None
    blocks = len(rows) // _ROWS + 1
    where: dict[int, int] = {}  # the rows of each word, as bits by block of rows
    for i, word in enumerate(rows, 1):
        at = word * blocks + i // _ROWS
        where[at] = where.get(at, 0) | 1 << i % _ROWS
    mask = (1 << 2 * allowed + 1) - 1
    top = 1 << 2 * allowed
    more, fewer = mask >> allowed + 1 << allowed + 1, 0  # column 0: each row one more than the row above, from row 1 on
    more, fewer = more >> 1 | top, 0
    watched, distance = 1 << allowed + gap, max(gap, 0)  # the diagonal that ends in the last cell
    for j, word in enumerate(columns, 1):
        low, equal = j - allowed, 0  # the row of the lowest bit
        for k in range(max(low, 0) // _ROWS, min((j + allowed) // _ROWS, blocks - 1) + 1):
            bits = where.get(word * blocks + k)
            if bits is not None:
                shift = k * _ROWS - low
                equal |= bits << shift if shift >= 0 else bits >> -shift
        equal &= mask
        diagonal = ((equal & more) + more ^ more) & mask | equal | fewer
        right_more = fewer | mask & ~(diagonal | more)
        right_fewer = diagonal & more
        if not diagonal & watched:
            distance += 1
            if distance > allowed:
                return None
        right_more = right_more << 1 | 1
        more = (right_fewer << 1 | mask & ~(diagonal | right_more)) & mask
        fewer = diagonal & right_more & mask
        more, fewer = more >> 1 | top, fewer >> 1
    return distance


def _text_key(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and node, the digest that stands for the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, node and sketches of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, packed = [], []
            for value in b.column(1).cast(pa.large_binary()):
                raw = value.as_py()
                nodes.append(hashlib.md5(raw).digest())
                packed.append(sketch(word_hashes(raw)[0]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "node", "sketches"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, node binary, sketches binary")


def _keys(texts: DataFrame) -> DataFrame:
    """(key, node): a row for each sketch of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.frombuffer(x.as_py(), np.int64) for x in b.column(1)]
            nodes = b.column(0).take(pa.array(np.repeat(np.arange(len(b)), [len(x) for x in each])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each or [np.zeros(0, np.int64)])), nodes], ["key", "node"])

    return texts.select("node", "sketches").mapInArrow(run, "key long, node binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (b.column(i).cast(pa.large_binary()) for i in (2, 3))
            value = np.array([edit_similarity(word_hashes(x.as_py())[0], word_hashes(y.as_py())[0]) for x, y in zip(left, right, strict=True)], np.float64)
            keep = pa.array(value >= SIMILARITY - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def links_between(labels: np.ndarray, words: list[np.ndarray], sketches: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the groups of some texts, as far as pairs with an equal sketch join them.

    Pairs of different groups are aligned, unless lengths and counts of words by bin rule a link out: an alignment leaves at
    least the words of the longer text that the shorter one lacks, and these are no fewer than the bins show. Pairs that
    lack the fewest come first, and pairs of groups that are joined by then are left out. ``side``: where it varies, only
    pairs of different values are looked at.
    """
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    labels, sizes, sketches, side = np.unique(labels[order], return_inverse=True)[1], sizes[order], sketches[order], side[order]
    words = [words[i] for i in order]
    counts = np.array([bins(w) for w in words])
    across = side.min() != side.max()
    allowed = ((1 - SIMILARITY) * sizes + 1e-9).astype(np.int64)  # of the longer, which comes later
    stop = np.searchsorted(sizes - allowed, sizes, "right")
    none = np.zeros(0, np.int64)
    left, right, lacks = [none], [none], [none]
    for i in range(len(sizes) - 1):
        j = np.arange(i + 1, stop[i])
        j = j[(labels[j] != labels[i]) & (side[j] != side[i])] if across else j[labels[j] != labels[i]]
        if len(j):
            lack = sizes[j] - np.minimum(counts[i], counts[j]).sum(1, dtype=np.int64)
            keep = (lack <= allowed[j]) & (sketches[i] == sketches[j]).any(1)
            left.append(np.full(int(keep.sum()), i))
            right.append(j[keep])
            lacks.append(lack[keep])
    left, right = np.concatenate(left), np.concatenate(right)
    root, found = list(range(int(labels.max(initial=0)) + 1)), []

    def leads(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for at in np.argsort(np.concatenate(lacks), kind="stable").tolist():
        i, j = int(left[at]), int(right[at])
        x, y = leads(int(labels[i])), leads(int(labels[j]))
        if x != y and edit_similarity(words[i], words[j]) >= SIMILARITY - 1e-12:
            root[x] = y
            found.append((int(order[i]), int(order[j])))
    return found


def _between(pairs: DataFrame, groups: DataFrame, bodies: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the groups that texts with a common centre are in; texts with an equal sketch have one."""
    members = pairs.select(F.col("a").alias("centre"), F.col("b").alias("node")).union(pairs.select(F.col("a").alias("centre"), "a").distinct())
    members = scratch.saved(members.join(groups, "node"))
    mixed = members.groupBy("centre").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    here = members.join(mixed.select("centre", "n"), "centre").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    # a text goes to each pair of blocks that its own is one of
    here = here.select("centre", "node", "label", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    here = scratch.saved(here.select(F.xxhash64("centre", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "label", "own"))
    parts = math.ceil(here.count() / BLOCK) + 1
    here = here.join(bodies, "node").withColumn("part", F.pmod("cell", F.lit(parts)).cast("int"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cell, own, nodes = group.column("cell").to_numpy(), group.column("own").to_numpy(), group.column("node")
        words = [word_hashes(x.as_py())[0] for x in group.column("text").cast(pa.large_binary())]
        labels = np.unique(np.array(group.column("label").to_pylist(), "S16"), return_inverse=True)[1]
        sketches = np.repeat(np.arange(len(cell), dtype=np.uint64)[:, None], 2 * SKETCHES, 1)  # equal to none where a kind is missing
        for i, (x, w) in enumerate(zip(group.column("sketches").to_pylist(), words, strict=True)):
            own_sketches = np.frombuffer(x, np.uint64)
            first = 0 if len(w) < MIDDLE[1] else SKETCHES
            sketches[i, first : first + len(own_sketches)] = own_sketches
        order, found = np.argsort(cell, kind="stable"), []
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            found += [(int(rows[i]), int(rows[j])) for i, j in links_between(labels[rows], [words[k] for k in rows], sketches[rows], own[rows])]
        left, right = (np.array([x[k] for x in found], np.int64) for k in range(2))
        return pa.table({"a": nodes.take(pa.array(left)), "b": nodes.take(pa.array(right))})

    return here.groupBy("part").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size of every row: the group of texts that links join, named by its least doc_id.

    Equal texts share a class; two texts are linked if their word edit similarity is at least 0.8 and they share a
    sketch. Whole texts count, however long: the band of an alignment is a fifth of their words. Null texts count as
    empty, and texts without words are linked to each other. Rows with a null doc_id get a class; its name is null if no
    other row is in it. Repeated rows are repeated in the result, and ties of any kind don't change the classes; other
    columns are not read. An empty table gives no rows. Tables of sketches, candidates and links are written to the
    shared folder and dropped, but for the two that the result reads.
    """
    return _classes(docs).select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each near-duplicate group left, that of the least doc_id; nulls come last.

    A tie of doc_id goes to the lesser digest of the text, and of repeated rows one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")))
    kept = _classes(docs).groupBy("label").agg(first.alias("kept")).select("kept.kept_id", "kept.kept_node")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumn("kept_node", F.unhex(F.md5(text))).withColumn("kept_id", F.col("doc_id").cast("long"))
    # equal rows of one id meet here and one of them stays
    joined = rows.alias("r").join(kept.alias("k"), (F.col("r.kept_node") == F.col("k.kept_node")) & F.col("r.kept_id").eqNullSafe(F.col("k.kept_id")), "left_semi")
    return joined.dropDuplicates(["kept_node", "kept_id"]).select(*docs.columns)


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, label, class_id and class_size of every row; nodes with one label are one group."""
    with Scratch(docs.sparkSession) as scratch:
        sketched = scratch.saved(_sketched(docs))
        rows = scratch.kept(sketched.select("doc_id", "node"))
        # copies of a text are met before the shuffle and after it, and count once from here on
        texts = scratch.saved(sketched.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("sketches").alias("sketches")))
        keys = _keys(texts)
        centres = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
        members = scratch.saved(keys.join(centres, "key"))

        # the texts in buckets, one row of each
        wanted = members.select("node").distinct().join(texts.select("node", "least_id", "sketches"), "node")
        source = _text_key(docs)
        one = source.join(wanted.withColumnRenamed("node", "wanted"), (source.node == F.col("wanted")) & source.doc_id.eqNullSafe(F.col("least_id")))
        bodies = scratch.saved(one.select("node", "text", "sketches").dropDuplicates(["node"]))

        pairs = scratch.saved(members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
        linked = components(scratch.saved(_verified(pairs, bodies)), scratch)
        groups = scratch.saved(bodies.select("node").join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
        links = _between(pairs, groups, bodies.select("node", "text", "sketches"), scratch)
        for end in ("a", "b"):
            links = links.join(groups.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
        merged = components(scratch.saved(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))), scratch)
        merged = merged.select(F.col("node").alias("label"), F.col("label").alias("next"))
        groups = groups.join(merged, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        placed = texts.select("node", "least_id", "copies").join(groups, "node", "left")
        placed = scratch.kept(placed.select("node", "least_id", "copies", F.coalesce("label", "node").alias("label")))
    classes = placed.groupBy("label").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    by_text = placed.select("node", "label").join(classes, "label")
    return rows.join(by_text, "node").select("doc_id", "node", "label", "class_id", "class_size")
