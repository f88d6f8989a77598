"""Connected components of a table of links, by labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the least node of its component.

    A round gives every node the least label among itself and its neighbours,
    then follows the label's own label, so long chains shorten by more than
    half each round.  Rounds are written tables in the shared folder; the loop
    ends with the round that changes nothing.  Joins and minima are ordinary
    shuffles with map-side aggregation, so a node with very many links is
    split like any skewed join key.
    """
    both = cut(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "components-links",
    )
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "components")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        best = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = best.join(jump, "label", "left").select(
            "node", F.least(F.col("label"), F.coalesce("further", "label")).alias("label")
        )
        old = labels.withColumnRenamed("label", "was")
        new = cut(step.join(old, "node"), "components")
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
