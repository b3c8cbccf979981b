"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``edges``.

    Each round every id takes the least label among its own, its neighbours'
    and its label's label (hooking and pointer jumping in one), so that long
    chains shrink geometrically.  A round is one equi-join on ids and one
    minimum with map-side combining; a hub's edges are never collected.
    """
    both = cut(edges.select(F.col(a).alias("id"), F.col(b).alias("other"))
               .unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("other")))
               .where("id IS NOT NULL AND other IS NOT NULL AND id <> other").distinct())
    labels = cut(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("id", "other"), "other")
                .groupBy("id").agg(F.min("component").alias("near")))
        hooked = labels.join(near, "id", "left").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # The old label of an id also learns of the new one: whole trees move at once.
        told = hooked.groupBy(F.col("old").alias("id")).agg(F.min("component").alias("told"))
        hooked = hooked.join(told, "id", "left").select("id", "old", F.least("component", "told").alias("component"))
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("far"))
        after = cut(hooked.join(jump, "component", "left").select(
            "id", "old", F.least("component", "far").alias("component")))
        moved = after.where("component <> old").limit(1).count()
        labels = after.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
