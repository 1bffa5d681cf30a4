"""Connected components of a graph whose edges are a table.

Alternating stars: the large star moves the larger neighbours of every node to
the smallest of its neighbourhood, the small star does so with the smaller
ones; when nothing changes, each component is a star around its smallest node.
Each step is a stored table, so nothing is computed again after a lost executor,
and both sides of every join are exchanged tables, which lets adaptive execution
split the node that a large component is gathered around.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.scratch import Scratch


def _large(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    least = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for the nodes of ``edges`` (src, dst, bigint). Loops and repeated edges do no harm."""
    scratch = Scratch(edges.sparkSession, "components")
    src, dst = F.col("src"), F.col("dst")
    now = edges.where(src != dst).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    now, before, turn = scratch.save(now, "edges-0"), None, 0
    while True:
        # the count and a sum of hashes tell whether the stars have changed
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, turn = state, turn + 1
        large = scratch.save(_large(now, scratch, f"large-{turn}"), f"large-{turn}")
        now = scratch.save(_small(large, scratch, f"small-{turn}"), f"edges-{turn}")
        for name in (f"large-{turn}", f"large-{turn}-least", f"small-{turn}-least", f"edges-{turn - 1}"):
            scratch.drop(name)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
