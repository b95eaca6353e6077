"""Connected components of large graphs by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planar.llm.joins import attach
from planar.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``a, b`` (bigints): the label is
    one of the nodes of its component, the same for all of them.

    In each round every node points to its smallest neighbour or itself, pointers
    are followed, and the graph shrinks to the nodes pointed to. All tables
    stay distributed; the number of rounds is logarithmic for the graphs here. Many
    edges may share an end, and many nodes a label, so all joins are prepared for hot keys.
    """
    spark = edges.sparkSession
    both = edges.where(F.col("a") != F.col("b"))
    now = written(spark, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(spark, nodes.withColumn("label", F.col("node")), "labels")
    while not now.isEmpty():
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = ends.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        hook = written(spark, hook, "hooks")
        step = hook.select(F.col("a").alias("to"), F.col("to").alias("far"))
        hook = written(spark, attach(hook, step, "to", "inner").select("a", F.col("far").alias("to")), "hooks")
        labels = attach(labels, hook.select(F.col("a").alias("label"), "to"), "label")
        labels = written(spark, labels.select("node", F.coalesce("to", "label").alias("label")), "labels")
        now = attach(now, hook.select("a", F.col("to").alias("to_a")), "a", "inner")
        now = written(spark, now.select(F.col("to_a").alias("a"), "b"), "edges")
        now = attach(now, hook.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b", "inner").where(F.col("a") != F.col("to_b"))
        now = written(spark, now.select(F.least("a", "to_b").alias("a"), F.greatest("a", "to_b").alias("b")).distinct(), "edges")
    return labels
