"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Hangs each node's larger neighbours (or else its smaller ones and itself) on its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    hung = join_counted(both, least, "u", "n", 2 * total)
    if large:
        hung = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has an edge: root is the least node that it reaches.

    ``edges`` has columns ``a, b`` (either order; loops and repeats do no harm). Each round is written to the shared
    folder. A node's neighbours are only ever summed up by a minimum, joined and made distinct, never gathered; those of a
    node with very many are joined where they are.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(edges.filter(F.col("a") != F.col("b")).select(a.alias("a"), b.alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = now
        edges = cut(_stars(cut(_stars(edges, True, now[0]), "stars"), False, now[0]), "stars")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
