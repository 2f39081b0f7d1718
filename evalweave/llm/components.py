"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalweave.llm.shared import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: every linked node with the smallest node of its component.

    Nodes take the smallest label among their neighbours and then their label's own label,
    until nothing changes; the number of rounds grows with the logarithm of the longest
    chain. Each round is written to shared storage, nothing but a count reaches the driver,
    and minima are taken before the shuffle, so that a hub costs no more than other nodes.
    Links with a NULL end are ignored.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    labels = written(labels, "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("near")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        joined = labels.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        moved = written(
            joined.join(above, "root", "left").select(
                "node", "old", F.least("root", F.coalesce("jump", "root")).alias("root")
            ),
            "labels",
        )
        labels = moved.select("node", "root")
        if moved.filter("root <> old").isEmpty():
            return labels
