"""Connected components by label propagation with shortcuts, for small graphs of judged pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_ids(links: DataFrame, a: str, b: str, write=lambda df: df.checkpoint()) -> DataFrame:
    """(node, component): the least node that each linked node reaches."""
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = write(both.union(both.select("other", "node")).distinct())
    labels = write(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(seen, "node").select("node", F.least("component", "near").alias("component"))
        hop = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = write(step.join(hop, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), F.lit(1).alias("x")).drop("x"))
        changed = new.join(labels, ["node", "component"], "left_anti").limit(1).count()
        labels = new
        if not changed:
            return labels
