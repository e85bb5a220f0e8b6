"""Connected components by alternating stars, all in DataFrame operations.

Each round replaces the edges by ones that point nearer to the smallest node:
the large star hangs every larger neighbour of a node on the node's smallest
neighbour, the small star does so with the smaller ones. Rounds grow with the
logarithm of the longest path; no node's neighbours are ever gathered in one row,
and the edges of a hub are not shuffled to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialize, release, spread_join


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """edges have u > v. Every u goes to the smallest node around its v."""
    both = edges.select("v", F.col("u").alias("w"), F.lit(1).alias("n")).union(edges.select(F.col("u").alias("v"), F.col("v").alias("w"), F.lit(0)))
    least = both.groupBy("v").agg(F.min("w").alias("low"), F.sum("n").alias("n")).where("n > 0").select("v", F.least("v", "low").alias("low"), "n")
    hung = spread_join(edges, least, "v", "n", total).select("u", F.col("low").alias("v"))
    return hung.where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node at or below u goes to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    hung = spread_join(edges, least, "u", "n", total).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.union(least.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, u: str, v: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Only nodes with an edge to another node are returned. Null ends, self loops
    and repeated edges have no effect; no edges give no rows. Nodes may be of any
    ordered type.
    """
    now = materialize(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    if is_empty(now):
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = _mark(now)
    for _ in range(max_rounds):
        star = materialize(_large_star(now, mark[0]), "stars", replaces=now)
        now = materialize(_small_star(star, mark[0]), "edges", replaces=star)
        if (new := _mark(now)) == mark:
            break
        mark = new
    else:
        release(now)
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v"), F.col("v").alias("c")))
