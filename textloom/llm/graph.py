"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node that each node of edges (a bigint, b bigint) is connected with.

    Large-star and small-star steps alternate until the table no longer changes; each round is written to the shared
    folder, so that lineage stays short and lost executors cost no more than a round. No edges: no rows. Loops and
    repeated edges change nothing.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    told = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        step = low.select("u", F.col("m").alias("v")).union(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, now = now, written(step, name)
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == told or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = seen
