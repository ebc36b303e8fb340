"""Connected components of an edge list, by hooking and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametrics.plans.tables import write_once


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (src, dst: long); the smallest vertex
    names its component.

    In a round each vertex, and what it points to, takes the smallest label among its neighbours;
    then labels jump to the label's label. Both sides of each join are written tables, so a vertex
    with very many edges is split. The rounds end when no label changes.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = write_once(edges.select("src", "dst").unionByName(back).distinct(), "edges")
    labels = both.groupBy(F.col("src").alias("vertex")).agg(
        F.least(F.min("dst"), F.first("src")).alias("component")
    )
    labels = write_once(labels, "labels")
    weight = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == weight:  # labels only ever get smaller
            return labels
        weight = now
        seen = both.join(labels, both["src"] == labels["vertex"]).groupBy("dst").agg(
            F.min("component").alias("least")
        )
        hooked = labels.join(seen, labels["vertex"] == seen["dst"]).select(
            "vertex", "component", F.least("component", "least").alias("least")
        )
        pairs = F.array(F.struct("vertex", "least"), F.struct(F.col("component").alias("vertex"), "least"))
        hooked = hooked.select(F.inline(pairs)).groupBy("vertex").agg(F.min("least").alias("component"))
        hooked = write_once(hooked, "labels")
        target = hooked.select(F.col("vertex").alias("at"), F.col("component").alias("next"))
        labels = write_once(
            hooked.join(target, hooked["component"] == target["at"]).select(
                "vertex", F.col("next").alias("component")
            ),
            "labels",
        )
