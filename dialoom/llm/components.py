"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins on the edge table, so a node with very many neighbours is one partial sum
per task and a join side that Spark's skew handling may split; nothing is collected but two numbers per round. Each round
is a written table in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    others = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(scratch: Scratch, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges: (u, v) of any one orderable type -> (node, component), for nodes with a neighbour; component is the least node.

    Null ends and loops are left out; repeated edges and either direction are fine; without edges the result is empty.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == seen:
            break
        seen, before = state, now
        now = scratch.table(_small_star(_large_star(before)), "stars")
        scratch.drop(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
