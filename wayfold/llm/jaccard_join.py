"""Jaccard join of documents over word shingles, by vertical partitioning.

Method: the global order of shingles (that of their hashes) is cut into fragments, and each document's set with it. How
many shingles two linked sets of a size class can differ in is bounded, and there are more fragments than that, so some
fragment is the same in both: documents with an equal fragment become candidates, and no link is lost. The partial
overlaps of a candidate pair are counted fragment by fragment, in different tasks, and summed per pair.

Documents with equal sets are one node. Groups of near copies are not expanded into all pairs: a node is first compared
with the node that it shares most fragments with of those that come first in a fragment. Families that this leaves apart
are compared in blocks inside of tasks, by parities of counts (a sketch) that bound how many shingles two sets differ in:
first only a forest of the nearest pairs leaves a task, and when those are joined, every pair that the bound still allows.

Sets are of 64-bit hashes of shingles, and a node is named by 64 bits of the hash of its set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._bitmaps import Counters, bitmap, bucket, within
from wayfold.llm._hashing import mix, word_hashes
from wayfold.llm._store import Scratch
from wayfold.llm.components import components

WIDTH = 3
#: Linked: 100 * intersection >= 90 * union. Then two sets differ in at most a 19th of the sum of their sizes, and the smaller has 9 tenths of the larger.
PERCENT = 90
APART = (100 + PERCENT) // (100 - PERCENT)
COARSE = 4  # fragments in which exact overlaps are counted
BLOCK = 2048
EDGES = 500_000  # that a task holds before it reduces them to a forest
DEGREE = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size, fragments and spare fragments of the size classes; below the first, only equal sets are linked."""
    low, fragments, spare = [], [], []
    at = APART // 2
    while at < 1 << 40:
        most = at * 3 // 2
        differ = 2 * most // APART
        low.append(at)
        spare.append(1 + differ // 12)
        fragments.append(differ + 1 + spare[-1])
        at = most + 1
    return np.array(low), np.array(fragments), np.array(spare)


LOW, FRAGMENTS, SPARE = _classes()


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 3-word shingles of a UTF-8 text, A-Z in lower case; the whole sequence if it has fewer words."""
    words, _, _ = word_hashes(raw.lower())
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * _STEP + words[k : len(words) - width + 1 + k])
    return np.unique(h)


def node(of: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(of.tobytes()).digest()[:8], "little", signed=True)


def signatures(of: np.ndarray) -> np.ndarray:
    """A hash of each fragment of a set, for its size class and, if a linked set can lie there, the next.

    Linked sets have ``spare + 1`` equal fragments or more. Empty fragments are left out of sets with at most ``spare`` of
    them, so that an equal fragment with shingles is left; other sets send them too.
    """
    own = int(np.searchsorted(LOW, len(of), "right")) - 1
    out = []
    for k in (own, own + 1):
        if k < 0 or k != own and 100 * len(of) < PERCENT * LOW[k]:
            continue
        n = int(FRAGMENTS[k])
        bounds = np.searchsorted(((of >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(of, 5))])
        size = np.diff(bounds).astype(np.uint64)
        sig = mix(sums[bounds[1:]] - sums[bounds[:-1]] + mix(np.arange(n, dtype=np.uint64) * _STEP + size, k + 1))
        out.append(sig if (size == 0).sum() > SPARE[k] else sig[size > 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(of: np.ndarray) -> bytes:
    """Parities of the counts of shingles by the low bits of their hash: a power of two of them, eight a shingle or more."""
    bits = max(256, 1 << int(8 * len(of) - 1).bit_length())
    return np.packbits(np.bincount((of & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (64-bit words by row) brought to fewer words: what one bit less of the hash would give."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _sets(rows: DataFrame, wanted: Broadcast, schema: str, make: Callable[[int, np.ndarray], dict]) -> DataFrame:
    """What ``make`` returns (lists by column) for the sets of the wanted texts (text, digest); a task makes equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: dict[str, list] = {}
            size = 0
            digests = batch.column(1).to_numpy().view(np.uint64)
            for i in np.flatnonzero(within(wanted.value, bucket(mix(digests)))):
                of = shingles(batch.column(0)[i].as_py().encode("utf-8", "surrogatepass"))
                name = node(of)
                if name in seen or not len(of):
                    continue
                seen.add(name)
                for key, values in make(name, of).items():
                    out.setdefault(key, []).extend(values)
                size += 8 * len(of)
                if size > 16_000_000:
                    yield pa.RecordBatch.from_pydict(out)
                    out, size = {}, 0
            if out:
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, schema)


def _bitmap_of(digests: DataFrame, tasks: int) -> Broadcast:
    """A bitmap of the texts with these digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters()
        for batch in batches:
            counters.add(bucket(mix(batch.column(0).to_numpy().view(np.uint64))), np.ones(batch.num_rows, np.int64))
        for k, packed in counters.rows():
            yield pa.RecordBatch.from_pydict({"range": pa.array([k], pa.int32()), "packed": pa.array([packed], pa.binary())})

    return bitmap(digests.mapInArrow(run, "range int, packed binary"), 1, tasks)


class _Corpus:
    """The texts, and a text of each node, so that sets are made again only of those that are asked for."""

    def __init__(self, rows: DataFrame, texts: DataFrame, scratch: Scratch, tasks: int):
        self.rows, self.texts, self.scratch, self.tasks = rows, texts, scratch, tasks

    def sets(self, nodes: DataFrame, schema: str, make: Callable[[int, np.ndarray], dict]) -> DataFrame:
        wanted = self.texts.join(nodes.distinct(), "node", "left_semi").select("digest")
        return _sets(self.rows, _bitmap_of(wanted, self.tasks), schema, make)


def verified(corpus: _Corpus, pairs: DataFrame) -> DataFrame:
    """The linked ones among the pairs (a, b) of nodes: overlaps are counted by fragment and summed per pair.

    A node with many partners is dealt to a task per DEGREE of them.
    """
    pairs = corpus.scratch.saved(pairs.select("a", "b"))

    def cut(name: int, of: np.ndarray) -> dict:
        bounds = np.searchsorted(of >> np.uint64(62), np.arange(COARSE + 1, dtype=np.uint64))
        return {"node": [name] * COARSE, "fragment": list(range(COARSE)), "size": [len(of)] * COARSE, "part": [of[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]}

    parts = corpus.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), "node long, fragment long, size long, part binary", cut)
    parts = parts.groupBy("node", "fragment").agg(F.first("size").alias("size"), F.first("part").alias("part"))
    degrees = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEGREE).cast("int").alias("salts"))
    asked = pairs.join(degrees, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COARSE - 1).cast("long"))).alias("fragment"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("size").alias("size_b"), F.col("part").alias("part_b"))
    left = parts.join(degrees.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), "fragment", F.col("size").alias("size_a"), F.col("part").alias("part_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], ["a", "b", "size_a", "size_b", "both"])

    met = asked.join(right, ["b", "fragment"]).join(left, ["a", "fragment", "salt"]).select("a", "b", "size_a", "size_b", "part_a", "part_b")
    counted = met.mapInArrow(overlap, "a long, b long, size_a long, size_b long, both long").groupBy("a", "b", "size_a", "size_b").agg(F.sum("both").alias("both"))
    return corpus.scratch.saved(counted.where(100 * F.col("both") >= PERCENT * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b"))


def _forest(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the edges (x, y) of a forest that joins all that the edges join, the nearest first."""
    names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    one, two = ends[: len(x)].tolist(), ends[len(x) :].tolist()
    up, kept = list(range(len(names))), []
    for i in np.argsort(apart, kind="stable").tolist():
        p, q = one[i], two[i]
        while up[p] != p:
            up[p] = p = up[up[p]]
        while up[q] != q:
            up[q] = q = up[up[q]]
        if p != q:
            up[q] = p
            kept.append(i)
            if len(kept) == len(names) - 1:
                break
    return np.array(kept, np.int64)


def _near(group: pa.Table, forest: bool) -> pa.Table:
    """Pairs of two blocks (or of one with itself) that lie in different classes and may be linked by their sketches.

    As a ``forest`` of classes, or all of them.
    """
    side = group.column("side").to_numpy()
    names, class_, size = (group.column(c).to_numpy() for c in ("node", "class", "size"))
    words = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("sketch")]
    width = np.array([len(x) for x in words])
    alone = not (side == 1).any()
    found = [np.zeros((3, 0), np.int64)]
    held = 0
    for wide in np.unique(width):
        for narrow in np.unique(width):
            if max(wide, narrow) > 2 * min(wide, narrow) or alone and narrow < wide:
                continue  # sets of so different sizes are not linked; one block with itself is seen once
            left = np.flatnonzero((side == 0) & (width == wide))
            right = left if alone and wide == narrow else np.flatnonzero((side == (0 if alone else 1)) & (width == narrow))
            if not len(left) or not len(right):
                continue
            least = int(min(wide, narrow))
            x, y = (_folded(np.stack([words[i] for i in at]), least) for at in (left, right))
            few_x, few_y = (_folded(z, max(1, least // 4)) for z in (x, y))
            for i in range(0, len(left), 64):
                at = left[i : i + 64]
                apart = np.zeros((len(at), len(right)), np.int32)
                for w in range(few_x.shape[1]):
                    apart += np.bitwise_count(few_x[i : i + 64, w, None] ^ few_y[None, :, w])
                ok = (apart <= (size[at][:, None] + size[right][None, :]) // APART) & (class_[at][:, None] != class_[right][None, :])
                if alone and wide == narrow:
                    ok &= at[:, None] < right[None, :]
                p, q = np.nonzero(ok)
                for k in range(0, len(p), 4096):  # what the fewer parities allow is looked at by all of them
                    pk, qk = p[k : k + 4096], q[k : k + 4096]
                    exact = np.bitwise_count(x[i + pk] ^ y[qk]).sum(axis=1, dtype=np.int64)
                    good = exact <= (size[at[pk]] + size[right[qk]]) // APART
                    found.append(np.stack([at[pk[good]], right[qk[good]], exact[good]]))
                    held += int(good.sum())
                if forest and held > EDGES:
                    edges = np.concatenate(found, axis=1)
                    found = [edges[:, _forest(class_[edges[0]], class_[edges[1]], edges[2])]]
                    held = found[0].shape[1]
    edges = np.concatenate(found, axis=1)
    if forest:
        edges = edges[:, _forest(class_[edges[0]], class_[edges[1]], edges[2])]
    a, b = names[edges[0]], names[edges[1]]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _families(corpus: _Corpus, buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(family, node, size, sketch): classes that meet in a shared fragment form a family; those that meet no other are left out.

    ``buckets``: (sig, node) of shared fragments.
    """
    scratch = corpus.scratch
    named = scratch.saved(_classed(buckets, classes))
    torn = named.groupBy("sig").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("sig", "a")
    edges = named.join(torn, "sig").where("class != a").select("a", F.col("class").alias("b")).distinct()
    # the same families by fewer edges: a class and all that come before it are joined to the first of those
    edges = edges.withColumn("first", F.min("a").over(Window.partitionBy("b"))).select(F.col("first").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct()
    families = components(edges, scratch).select(F.col("node").alias("class"), F.col("label").alias("family"))
    members = scratch.saved(named.select("node", "class").distinct().join(families, "class").select("family", "node"))
    drawings = corpus.sets(members.select("node"), "node long, size long, sketch binary", lambda name, of: {"node": [name], "size": [len(of)], "sketch": [sketch(of)]})
    drawings = drawings.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    return scratch.saved(members.join(drawings, "node"))


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds the class of each row's node, which is the node itself where it is linked with nothing."""
    return rows.join(classes.withColumnRenamed("label", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))


def _left_over(members: DataFrame, classes: DataFrame, forest: bool, scratch: Scratch) -> DataFrame:
    """Pairs of a family's nodes in different classes whose sketches don't rule out a link.

    Members are dealt to blocks; a class of more than half a block has blocks of its own, which are not compared with
    each other, and a family of one class is done with.
    """
    members = scratch.saved(_classed(members, classes))
    sizes = members.groupBy("family", "class").agg(F.count("*").alias("n"))
    small = F.col("n") < BLOCK // 2
    torn = sizes.groupBy("family").agg(F.count("*").alias("parts"), F.sum(F.when(small, F.col("n")).otherwise(0)).alias("small")).where("parts > 1")
    dealt = sizes.join(torn, "family").select("family", "class", F.when(~small, F.col("class")).alias("own"), F.ceil(F.when(small, F.col("small")).otherwise(F.col("n")) / BLOCK).alias("blocks"))
    number = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("class")).otherwise(F.col("node"))), F.col("blocks"))
    members = scratch.saved(members.join(dealt, ["family", "class"]).select("family", "node", "class", "size", "sketch", "own", F.xxhash64("family", "own", number).alias("block")))
    blocks = members.select("family", "block", "own").distinct()
    one, two = (blocks.select("family", F.col("block").alias(f"{s}_block"), F.col("own").alias(f"{s}_own")) for s in ("x", "y"))
    meet = one.join(two, "family").where("x_block <= y_block AND NOT (x_own IS NOT NULL AND y_own IS NOT NULL AND x_own = y_own)")
    meet = meet.select(F.xxhash64("x_block", "y_block").alias("meeting"), "x_block", "y_block")
    sides = meet.select("meeting", F.col("x_block").alias("block"), F.lit(0).alias("side")).union(meet.where("x_block < y_block").select("meeting", F.col("y_block").alias("block"), F.lit(1).alias("side")))
    met = members.join(sides, "block").select("meeting", "side", "node", "class", "size", "sketch")
    return met.groupBy("meeting").applyInArrow(lambda group: _near(group, forest), "a long, b long").distinct()


_READ = "doc_id long, n_shingles long, node long, digest long, sig long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, text, digest): a row a document with its set's size and name, and a row a signature of each set."""
    seen: set[int] = set()
    for batch in batches:
        sizes, names, sigs, owners, held = [], [], [], [], 0
        for text in batch.column(1).cast(pa.binary()):
            of = shingles(text.as_py())
            sizes.append(len(of))
            names.append(node(of) if len(of) else None)
            if len(of) and names[-1] not in seen:
                seen.add(names[-1])
                sigs.append(signatures(of).view(np.int64))
                owners.append(np.full(len(sigs[-1]), names[-1], np.int64))
                held += len(sigs[-1])
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), batch.column(2), none(len(sizes))], ["doc_id", "n_shingles", "node", "digest", "sig"])
        if held:
            yield pa.RecordBatch.from_arrays([none(held), none(held), pa.array(np.concatenate(owners)), none(held), pa.array(np.concatenate(sigs))], ["doc_id", "n_shingles", "node", "digest", "sig"])


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A null or empty text, or one of white space, has no shingles and is linked with nothing: its component is its own id.
    Rows with equal sets, repeated rows among them, are linked. component_id is the least id of the component that is not
    null. Other columns are ignored. An empty table gives no rows. Memory: some 60 bytes a byte of the longest text, one
    block of sketches (8 to 16 bits a shingle), and the bitmap's counters.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    with Scratch(docs.sparkSession) as scratch:
        read = scratch.saved(whole.mapInArrow(_read, _READ))
        keyed = scratch.kept(read.where("sig IS NULL").select("doc_id", "n_shingles", "node", "digest"))
        texts = scratch.saved(keyed.where("node IS NOT NULL").groupBy("node").agg(F.min("digest").alias("digest")))
        corpus = _Corpus(whole.select("text", "digest"), texts, scratch, tasks)

        sigs = read.where("sig IS NOT NULL").select("sig", "node")
        shared = sigs.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("sig", "a")
        buckets = scratch.saved(sigs.join(shared, "sig"))
        stars = buckets.where("node != a").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
        best = stars.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select("best.a", "b")
        first = scratch.saved(best)
        links = verified(corpus, first)
        classes = components(links, scratch)
        members = _families(corpus, buckets.select("sig", "node"), classes)
        forest = scratch.saved(_left_over(members, classes, True, scratch))
        if not forest.isEmpty():
            nearest = scratch.saved(forest.join(first, ["a", "b"], "left_anti"))
            links = scratch.saved(links.union(verified(corpus, nearest)))
            classes = components(links, scratch)
            # classes only grow, so what is still apart lies in the same families
            rest = scratch.saved(_left_over(members, classes, False, scratch).join(first.union(nearest), ["a", "b"], "left_anti"))
            if not rest.isEmpty():
                more = verified(corpus, rest)
                if not more.isEmpty():
                    classes = components(links.union(more), scratch)

        least = keyed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first")).join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
        label_first = least.groupBy("label").agg(F.min("first").alias("component_id"))
        found = scratch.kept(least.join(label_first, "label").select("node", "component_id"))
    return keyed.join(found, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
