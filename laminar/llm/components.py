"""Connected components over an edge table by min-label propagation with pointer jumping, all in joins and aggregations.

Every round a node takes the smallest label among its own, its neighbours' and its label's label. Rounds are written tables in the shared
folder, so a lost executor repeats one round at most; the round before is dropped. Nothing but a count of changes reaches the driver, observed while the round is written. Joins are plain
equi-joins whose large partitions Spark splits; the minimum over neighbours is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges(a, b), undirected -> node, label (the smallest node of the component), for nodes that have an edge."""
    both = edges.select(F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))).alias("e")).select("e.*")
    both = common.written(both.where("src <> dst").distinct(), "cc-edges")
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
    labels = common.written(labels.select("node", F.least("node", "near").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("src"), F.col("label").alias("near")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("near").alias("near"))
        # jump: the label's own label; every label is a node
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = labels.join(near, "node").join(up, "label").select("node", F.least("label", "near", "up").alias("next"), "label")
        seen = Observation()
        step = common.written(step.observe(seen, F.count_if(F.col("next") < F.col("label")).alias("changed")).select("node", F.col("next").alias("label")), "cc-labels")
        common.dropped(labels)
        labels = step
        if not seen.get["changed"]:
            common.dropped(both)
            return labels
