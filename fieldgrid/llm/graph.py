"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component of every id in ``links`` (columns u, v): the smallest id reachable.

    Each round takes the least label among neighbours, then the label of that label, so that
    chains shorten by more than half; labels are written to the shared folder between rounds.
    No links give no rows.
    """
    both = cut(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("component")).select(F.col("u").alias("id"), "component"))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["id"] == near["u"]).select("id", F.col("component").alias("was"), F.least("component", "near").alias("least"))
        jump = labels.select(F.col("id").alias("least"), F.col("component").alias("then"))
        after = cut(least.join(jump, "least").select("id", "was", F.least("least", "then").alias("component")))
        labels = after.select("id", "component")
        if after.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
