"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store_table


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table: unlike a checkpoint it brings no constraints along, which a loop would pile up."""
    return store_table(df)[0]


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; the label is the smallest node of the component.

    Every round takes the smallest label among neighbours and then the label of
    that label, so a chain shortens by halves.  A round moves one row per node
    and link, and its result is a written table.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        closer = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "m").alias("to"))
        closer = stored(closer)
        heads = closer.select(F.col("node").alias("head"), F.col("to").alias("up"))
        after = stored(closer.join(heads, F.col("to") == F.col("head")).select("node", "label", F.least("to", "up").alias("to")))
        if after.where("label <> to").limit(1).count() == 0:
            return after.select("node", "label")
        labels = after.select("node", F.col("to").alias("label"))
