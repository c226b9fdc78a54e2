"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import drop_materialized, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b); the label is the least node of the component.

    Each round hooks the labels at both ends of every link, and the labels' own labels, to the lesser one, then
    jumps labels to their labels. Minima are combined before each shuffle, so a node with many links sends one row
    per task. Rounds are written to the shared folder; there are about as many as the logarithm of the diameter.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "components")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        ends = links.join(left, "a").join(right, "b").where("la != lb").withColumn("to", F.least("la", "lb"))
        hooks = ends.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), "to").groupBy("node").agg(F.min("to").alias("to"))
        hooked = labels.join(hooks, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "to").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = hooked.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), "old")
        step = materialize(step, "components")
        changed = step.where("label != old").count()
        drop_materialized(labels)
        labels = step.select("node", "label")
        if not changed:
            return labels
