"""Connected components of a link table by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and Spark knows its true size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of a link ``(a, b)``; the label is the component's least node.

    Each round gives a node the least label among itself and its neighbours (a partial and a
    final minimum per node), then the label that this label had before.  Rounds end when no
    label changes; every round is one job, written and read again.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least"))
                            .select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        step = (near.withColumn("was", F.lit(None).cast(labels.schema["label"].dataType))
                .union(labels.select("node", "label", F.col("label").alias("was")))
                .groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = stored(step.join(far, step["label"] == far["via"])
                      .select("node", "was", F.least("label", "far").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("label != was").isEmpty():
            return labels
