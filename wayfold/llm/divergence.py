"""Divergence of the sources of each language, by wide term vectors.

Method: terms are counted by language and source, first inside of tasks, then over the corpus. The counts of a term
are pivoted into one array that the language's sources index; higher-order functions turn it into smoothed shares and
emit what the term adds to each pair of sources, and partial sums by pair leave the tasks. The work follows the number
of kept terms times the pairs of sources, which is the size of the result times the terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._store import Scratch

LEAST_DOCS = 10
UNIT = 1_000_000_000
TOP_TERMS = 10
SALTS = 64  # a language's terms meet its sources in so many tasks
FLUSH = 400_000  # entries that a task counts before it passes them on
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, source, text): (lang, source, term, n, docs), summed as far as memory allows."""
    tally: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in tally.items():
            terms = list(n)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()),
                "term": pa.array(terms, pa.binary()).cast(pa.string()), "n": pa.array([n[t] for t in terms], pa.int64()), "docs": pa.array([docs[t] for t in terms], pa.int64()),
            })
        tally.clear()

    for batch in batches:
        bodies = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, strict=True):
            terms = text.as_py().translate(_LETTERS).split()
            n, docs = tally.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            entries += len(n) - before
            if entries > FLUSH:
                yield from passed()
                entries = 0
    yield from passed()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)); products may pass 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), (total + 2 * terms).cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language and their foremost terms.

    Null texts, languages and sources are read as ''. Every row counts as a document, repeated ones too; other columns
    are ignored. A group without a kept term has pairs of value 0 if its language keeps none, and no terms. Ties go by
    the bytes of the item. An empty table gives no rows. Memory: a task holds FLUSH terms and one document; a term's
    array holds a number for each source of its language.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    scratch = Scratch(docs.sparkSession)
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    wide = scratch.kept(wide.where(F.col("docs") >= least_docs).drop("docs"))

    totals = wide.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("v"))
    index = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("lang_n"))
    index = scratch.kept(index.join(kept, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0))))

    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    vectors = wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    counts = F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s["source"]), F.lit(0)))
    vectors = vectors.withColumn("counts", counts)
    vectors = vectors.select("lang", "term", "n", "lang_n", "v", "sources", "counts", F.zip_with("counts", "sources", lambda c, s: share(c, s["n"], F.col("v"))).alias("p"))

    rest = F.expr("slice(p, i + 2, size(p))")
    adds = vectors.select("lang", "p", F.posexplode("p").alias("i", "a")).where("i + 1 < size(p)")
    adds = adds.select("lang", "i", "a", F.posexplode(F.transform(rest, lambda b: distance(F.col("a"), b))).alias("k", "add"))
    sums = adds.groupBy("lang", "i", (F.col("i") + 1 + F.col("k")).alias("j")).agg(F.sum("add").alias("value"))
    named = index.select("lang", "sources", F.posexplode("sources").alias("i", "one")).select("lang", "i", "one", F.posexplode("sources").alias("j", "other")).where("i < j")
    pairs = named.select("lang", "i", "j", F.col("one.source").alias("one"), F.col("other.source").alias("other")).join(sums, ["lang", "i", "j"], "left")
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("side")
    pairs = pairs.select("lang", both, F.coalesce("value", F.lit(0)).alias("value")).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    q = share(F.col("n"), F.col("lang_n"), F.col("v"))
    own = F.arrays_zip("sources", "counts", "p")
    terms = vectors.withColumn("q", q).select("lang", "term", "q", F.explode(F.filter(own, lambda x: (x["counts"] > 0) & (x["p"] > F.col("q")))).alias("x"))
    terms = terms.select("lang", F.col("x.sources.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("x.p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)


#: DuckDB SQL with the rows of the registered query.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT lang, source, k, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 10),
size_of AS MATERIALIZED (SELECT lang, count(*) AS v FROM v GROUP BY 1),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * size_of.v)::HUGEINT AS p
    FROM g JOIN v USING (lang) JOIN size_of USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS MATERIALIZED (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS q
    FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY 1) USING (lang) JOIN size_of USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 10
"""
