"""Connected components by alternating star contractions, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialspark.llm.common import held


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(
        F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id that has an edge; component_id is the smallest id reachable.

    Each round joins every node to the smallest neighbour it knows; groups shrink to stars in a
    number of rounds that grows with the logarithm of the longest path. Node minima come from
    partial aggregation and the joins are plain equi joins, so that a node with very many edges is
    split by adaptive execution. Nulls and self loops are ignored; no edges give an empty table.
    """
    cur = held(edges.filter(f"{a} <> {b}").select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        cur = held(_stars(cur), "stars")
    out = cur.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return out.unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
