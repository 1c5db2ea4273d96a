"""Connected components of an edge table, by joins (no collection to the driver).

Alternates two steps on a table of directed edges u -> v with u > v: the large star hangs
each larger neighbour of a node on the node's smallest neighbour, the small star does so
for the smaller ones; the table converges to stars whose centre is the smallest node of
each component, in about log(diameter) rounds.  Each round is written to the shared
folder, so lineage stays short and a lost executor costs tasks, not rounds.

A hub of many neighbours is only ever aggregated by ``min`` (combined before the shuffle)
and joined to its own edges, a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v.  large: every larger neighbour of a node is hung on the least
    of the node and its neighbours; small: the node and its smaller neighbours are."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u")
        out = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component: its smallest node."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = durable(now, "edges")
    before = None
    for _ in range(most_rounds):
        now = durable(_star(_star(now, True), False), "stars")
        # unchanged edges: their number and the sums of their hashes are the same
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
