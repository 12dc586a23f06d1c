"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrain.llm.common import forget, gathered, materialise


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """node and root (the smallest node of its component), a row per node of an edge; edges without loops, in either direction.

    Each round takes the smallest label among neighbours and then the label's own label, so labels travel far in few rounds. Rounds end
    when no label changes; each is written, so a lost executor costs one round at most. Joins are plain equi-joins, which skew-join
    handling can split; minima are taken on the map side first.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialise(gathered(both.union(both.select("v", "u")).distinct()), f"{name}-edges")
    labels = materialise(gathered(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("l"))), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("x")), "v").groupBy("u").agg(F.min("x").alias("x"))
        low = labels.select("u", "l").join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "x").alias("l"))
        jump = low.join(labels.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l", "left").select("u", "old", F.least("l", F.coalesce("ll", "l")).alias("l"))
        found = materialise(gathered(jump), f"{name}-labels")
        forget(labels)
        if found.filter("l != old").isEmpty():
            forget(both)
            return found.select(F.col("u").alias("node"), F.col("l").alias("root"))
        labels = found
