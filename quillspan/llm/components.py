"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import discard, spool


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; the component is its smallest node.

    Each turn a node takes the smallest label among its neighbours and itself, then its label's label, so the number
    of turns grows with the logarithm of a component's diameter. Labels are spooled each turn and those before deleted;
    only whether any changed comes to the driver. Minima are taken before the shuffle, so a node of many links is no
    burden to one task. Links with a null end are left out; repeated links and links to itself do no harm.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    both = spool(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = spool(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        seen = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        moved = seen.join(jump, "component", "left").select("node", F.least("component", F.coalesce("jump", "component")).alias("component"), "was")
        moved = spool(moved, "labels")
        changed = moved.where("component <> was").limit(1).count()
        discard(labels)
        labels = moved.drop("was")
        if not changed:
            discard(both)
            return labels
