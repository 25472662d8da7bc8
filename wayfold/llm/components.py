"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._store import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) for every node of the links (a, b); equal labels where a path joins two nodes.

    Each round a node takes the least label among itself, its neighbours and its label's label, so labels travel twice
    as far as the round before; it ends when a round changes none. Each round is written to the shared folder, which
    keeps the lineage short, and the table of the round before is dropped; the last goes with ``scratch``, if there is one.
    """
    kind = links.schema["a"].dataType
    with Scratch(links.sparkSession) as whole:
        both = whole.saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        last = Scratch(links.sparkSession)
        labels = last.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
        while True:
            own = labels.select("node", "label", F.col("label").alias("was"))
            near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast(kind).alias("was"))
            step = own.union(near).groupBy("node").agg(F.min("label").alias("next"), F.min("was").alias("was"))
            beyond = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
            step = step.join(beyond, "next").select("node", "was", F.least("next", "beyond").alias("label"))
            here = Scratch(links.sparkSession)
            step = here.saved(step)
            last.drop()
            last, labels = here, step.select("node", "label")
            if not step.where("was != label").limit(1).count():
                if scratch is not None:
                    scratch.gone += last.gone
                return labels
