"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, folder, stored, swept


def _lowest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u; a groupBy with partial sums and a
    join, which splits a hub over tasks, rather than a window, which does not."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _lowest(both).withColumn("m", F.least("u", "m"))
    return near.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _lowest(edges)
    pairs = F.when(F.col("v") == F.col("m"), F.array(F.struct(F.col("u"), F.col("m").alias("v")))).otherwise(
        F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    )
    return near.select(F.inline(pairs)).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, base: str | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reached.

    Edges are undirected; loops, repeats and nulls do not matter. Every round is stored in
    the shared folder (under base), so a lost executor costs at most one round; the round
    before goes.
    """
    spark = edges.sparkSession
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    base, before = base or folder(spark, "components"), None
    with swept(spark):
        e = stored(e, f"{base}/0")
        for k in range(max_rounds):
            e = stored(_small_star(_large_star(e)), f"{base}/{k + 1}")
            dropped(spark, f"{base}/{k}")
            now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
            if now == before or not now[0]:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
