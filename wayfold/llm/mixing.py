"""Mixing sources to target weights by iterative proportional fitting.

Method: the tokens of each cell (source, language, topic) are summed over the corpus; the table of cells is then raked,
one marginal after the other, until its sums by source, by language and by topic meet the targets. A cell's ratio of
raked to present tokens is the weight of its documents, and the share of them that is sampled is that weight divided by
the largest one (times ``rate``), or, where a ``share`` of the tokens is given, what brings the sample to that size whatever
the largest weight is: probabilities in proportion to the weights, clipped at 1, the excess spread over the other cells.
Whether a document is sampled depends only on a hash of its id and text.

Only DataFrame functions are used. The corpus is shuffled only as partial sums by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._store import Scratch, saved

MARGINS = ("source", "lang", "topic")
SWEEPS = 12
SWEEPS_A_PLAN = 3
SMALL = 100_000  # cells
SOURCE_POWER, LANGUAGE_POWER, TOPIC_POWER = 0.5, 0.7, 1.0
UNKNOWN = "unknown"


def tokens() -> Column:
    """Words of the text: the runs of characters other than white space; 0 for a null text."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic() -> Column:
    """The form of a text, from a few signs in it; the first that fits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("http"), "links")
        .when(text.rlike("[0-9]"), "figures")
        .when(text.contains("!!"), "shouting")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target): shares of the tokens by this margin, raised to a power and brought back to a sum of 1."""
    shares = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).where("n > 0").select(margin, F.pow(F.col("n").cast("double"), F.lit(power)).alias("raised"))
    total = shares.agg(F.sum("raised").alias("whole"))
    return shares.select(margin, (F.col("raised") / total.select("whole").scalar()).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Adds ``raked`` to the cells: tokens fitted to the targets, which are shares by margin.

    A value without a target gets none of the tokens. After ``sweeps`` rounds over the margins the last one is met
    exactly, the others as nearly as the rounds allow. Each step divides by a window's sum. Up to SMALL cells lie in one
    partition, where the windows need no exchange; more are dealt anew for each margin.
    """
    whole = cells.agg(F.sum("tokens").cast("double").alias("whole"))
    current = cells.withColumn("raked", F.col("tokens").cast("double")).withColumn("whole", whole.scalar())
    for margin, target in targets.items():
        share = target.select(margin, F.col("target").alias(f"target_{margin}"))
        current = current.join(share, margin, "left").withColumn(f"target_{margin}", F.coalesce(f"target_{margin}", F.lit(0.0)))
    if cells.count() <= SMALL:
        current = current.coalesce(1)
    with Scratch(cells.sparkSession) as scratch:
        for k in range(sweeps):
            if k and k % SWEEPS_A_PLAN == 0:
                current = scratch.saved(current)  # a plan of all sweeps is too deep to be sent to tasks with small stacks
            for margin in targets:
                now = F.sum("raked").over(Window.partitionBy(margin))
                current = current.withColumn("raked", F.when(now > 0, F.col("raked") * F.col(f"target_{margin}") / now * F.col("whole")).otherwise(0.0))
        return scratch.kept(current.select(*cells.columns, "raked"))


def to_share(raked: DataFrame, share: float) -> DataFrame:
    """Adds ``probability`` to the raked cells: least(1, factor * weight), so that ``share`` of all tokens is expected.

    With cells by falling weight, the factor follows from the first cells, kept whole, and what is left for the others;
    it is the first one under which the next cell is not clipped. Cells of weight 0 give nothing, even for a large share.
    """
    falling = Window.orderBy(F.desc("weight"), *MARGINS)
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    rest = falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = raked.where("weight > 0").coalesce(1).select(
        "weight", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("whole_cells"), F.sum("raked").over(rest).alias("others"),
    )
    wanted = raked.agg((F.sum("tokens") * share).alias("wanted"))
    steps = steps.withColumn("factor", (wanted.scalar() - F.col("whole_cells")) / F.col("others"))
    # null if even whole cells don't reach the share
    factor = steps.where(F.col("factor") * F.col("weight") <= 1).agg(F.max(F.struct("weight", "factor")).alias("best")).select("best.factor")
    return raked.withColumn("probability", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.coalesce(factor.scalar() * F.col("weight"), F.lit(1.0)))).otherwise(0.0))


def sampling_position() -> Column:
    """A number in [0, 1) from the document's id and text."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def labelled(docs: DataFrame) -> DataFrame:
    """The documents with their cell and tokens; a null source or language is a value of its own."""
    kept = [c for c in docs.columns if c not in ("topic", "tokens", "cell_source", "cell_lang")]
    return docs.select(*kept, F.coalesce("source", F.lit(UNKNOWN)).alias("cell_source"), F.coalesce("lang", F.lit(UNKNOWN)).alias("cell_lang"), topic().alias("topic"), tokens().alias("tokens"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = 1.0, sweeps: int = SWEEPS, share: float | None = None) -> DataFrame:
    """Every document with its cell, weight, probability and whether it is sampled.

    Adds topic, tokens, weight, probability and sampled to the columns of ``docs`` (which lose columns of these names).
    ``targets``: shares by "source", "lang" and "topic" as tables (margin, target); by default the corpus's own shares,
    tempered. Null sources and languages form the value "unknown". A document without tokens, as one with a null text,
    has weight and probability 0. Equal rows are sampled alike. ``share``: the part of all tokens to expect in the sample;
    without it the cell of the largest weight is kept at ``rate`` and sets the size of the sample.
    """
    names = ["topic", "tokens", "weight", "probability", "sampled"]
    rows = labelled(docs.drop(*names))
    cells = rows.groupBy(F.col("cell_source").alias("source"), F.col("cell_lang").alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))
    cells = saved(cells.where("tokens > 0"))
    powers = dict(zip(MARGINS, (SOURCE_POWER, LANGUAGE_POWER, TOPIC_POWER), strict=True))
    targets = targets or {m: tempered(cells, m, p) for m, p in powers.items()}
    raked = rake(cells, targets, sweeps).withColumn("weight", F.col("raked") / F.col("tokens"))
    if share is None:
        largest = raked.agg(F.max("weight").alias("largest")).select("largest").scalar()
        raked = raked.withColumn("probability", F.least(F.lit(1.0), F.col("weight") / largest * rate))
    else:
        raked = to_share(raked, share)
    weights = raked.select(F.col("source").alias("cell_source"), F.col("lang").alias("cell_lang"), "topic", "weight", "probability")
    placed = rows.join(weights, ["cell_source", "cell_lang", "topic"], "left")
    zero = F.col("tokens") == 0
    weight, probability = (F.when(zero, 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in (F.col("weight"), F.col("probability")))
    placed = placed.withColumns({"weight": weight, "probability": probability})
    return placed.withColumn("sampled", sampling_position() < F.col("probability")).select(*[c for c in docs.columns if c not in names], *names)


def oracle(sweeps: int = SWEEPS) -> str:
    """DuckDB SQL with the rows of the registered query."""
    steps, last = [], "c0"
    for k, (n, margin) in enumerate([(s, m) for s in range(sweeps) for m in MARGINS], 1):
        steps.append(f"""c{k} AS MATERIALIZED (SELECT source, lang, topic, tokens, raked * t.target / n.now * w.whole AS raked
            FROM {last} JOIN (SELECT {margin}, sum(raked) AS now FROM {last} GROUP BY 1) n USING ({margin}) JOIN t_{margin} t USING ({margin}), w)""")
        last = f"c{k}"
    powers = dict(zip(MARGINS, (SOURCE_POWER, LANGUAGE_POWER, TOPIC_POWER), strict=True))
    targets = [
        f"""t_{m} AS MATERIALIZED (SELECT {m}, pow(n, {p}) / sum(pow(n, {p})) OVER () AS target
            FROM (SELECT {m}, sum(tokens)::DOUBLE AS n FROM cells GROUP BY 1))"""
        for m, p in powers.items()
    ]
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang, coalesce(text, '') AS body,
            CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'http') THEN 'links'
                 WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'figures' WHEN contains(coalesce(text, ''), '!!') THEN 'shouting' ELSE 'prose' END AS topic,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
        cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
        {', '.join(targets)},
        w AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS whole FROM cells),
        c0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS raked FROM cells),
        {', '.join(steps)},
        p AS MATERIALIZED (SELECT source, lang, topic, raked / tokens AS weight, least(1.0, raked / tokens / max(raked / tokens) OVER ()) AS probability FROM {last})
        SELECT doc_id, d.source, d.lang, topic, tokens, round(CASE WHEN tokens = 0 THEN 0.0 ELSE coalesce(weight, 0.0) END, 6) AS weight,
            round(CASE WHEN tokens = 0 THEN 0.0 ELSE coalesce(probability, 0.0) END, 6) AS probability,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || body), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < CASE WHEN tokens = 0 THEN 0.0 ELSE coalesce(probability, 0.0) END AS sampled
        FROM d LEFT JOIN p USING (source, lang, topic)"""
