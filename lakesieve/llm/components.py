"""Connected components by contraction: no component and no hub has to fit one task.

Every node takes the neighbour (or itself) of least random rank as its label, edges are rewritten to labels, and what is
left is contracted again; ranks that don't follow the ids halve even long chains in every round. A table without edges
gives no rows; loops and repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesieve.llm._spark import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes of `edges` (a, b): component is the least id that links reach."""
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    maps = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        salt = F.lit(len(maps))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(salt, "b").alias("rank"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64(salt, "a").alias("rank"), F.col("a").alias("id"))
        labels = cut(near.select(F.col("a").alias("id"), F.least("m", own)["id"].alias("label")), "labels")
        maps.append(labels)
        left = labels.select(F.col("id").alias("a"), F.col("label").alias("x"))
        right = labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = cut(edges, "edges")
        if edges.isEmpty():
            break
    found = maps[0]
    for labels in maps[1:]:
        step = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        found = found.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    least = found.groupBy("label").agg(F.min("id").alias("component"))
    return cut(found.join(least, "label").select("id", "component"), "components", keep=True)
