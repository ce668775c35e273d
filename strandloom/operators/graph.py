"""Connected components of an edge table by label spreading with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.skew import spread_join
from strandloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``id, label``: each node of ``edges (a, b)`` with the least node of its component.

    Every round a node takes the least label among its neighbours, then the label of its label, so
    long chains shorten geometrically. Each round is written to the shared folder; only the number of
    changed labels comes to the driver. Hub nodes and the labels of giant components are joined by
    salt. Without edges the result is empty.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"), F.count("*").alias("degree")).withColumnRenamed("a", "id"), "labels")
    while True:
        told = labels.select(F.col("id").alias("b"), "label", "degree")
        near = spread_join(both, told, "b", "degree").groupBy("a").agg(F.min("label").alias("least"))
        spread = materialize(labels.join(near, labels.id == near.a).select("id", "degree", F.col("label").alias("old"), F.least("label", "least").alias("label")), "spread-labels")
        uses = spread.groupBy("label").agg(F.count("*").alias("uses"))
        jump = materialize(uses.join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label"), "label-jumps")
        moved = materialize(spread_join(spread, jump, "label", "uses").select("id", "degree", "old", F.least("label", "next").alias("label")), "labels")
        if moved.where("label <> old").isEmpty():
            return moved.select("id", "label")
        labels = moved.select("id", "label", "degree")
