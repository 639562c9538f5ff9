"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stocktake.llm.shared import joined, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge.

    Each round every node takes the smallest label among itself and its neighbours and then the
    label of that label, so a path of length n needs about log n rounds. Every round is written
    to shared scratch; only whether a node changed reaches the driver. Work grows with the edges:
    give few a node, none of which need be direct.
    """
    x, y = F.col(a), F.col(b)
    ends = F.explode(F.array(*(F.struct(p.alias("x"), q.alias("y")) for p, q in ((x, y), (y, x), (x, x), (y, y)))))
    both = written(edges.filter(x != y).select(ends.alias("e")).select("e.*").distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label")), "labels")
    while True:
        seen = joined(both, labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"), F.min(F.when(F.col("x") == F.col("y"), F.col("label"))).alias("old"))
        beyond = labels.select(F.col("node").alias("near"), "label")
        moved = written(joined(seen, beyond, "near").select("node", "old", "label"), "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
