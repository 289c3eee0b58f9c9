"""Connected components of edge tables whose hubs may hold any part of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import staged

MAX_ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root``: every node of the edges ``a, b`` (long) with the smallest node it is connected to.

    Alternating star rounds: every node's larger neighbours are tied to its smallest neighbour, then
    every node and its smaller neighbours are. Distances halve, so rounds grow with the logarithm of the
    longest chain. Minima are taken with map-side partials and written as a table of their own, one row
    per node; a hub's edges meet it in a plain join, which is broadcast or split where it is skewed.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(MAX_ROUNDS):
        low = staged(edges.groupBy("a").agg(F.min("b").alias("low")), name)
        # a node without smaller neighbours is its own smallest
        large = edges.join(low.select(F.col("a").alias("b"), "low"), "b", "left").select("a", F.coalesce("low", "b").alias("b"))
        large = staged(large.distinct(), name)
        low = staged(large.groupBy("a").agg(F.min("b").alias("low")), name)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        edges = staged(small.where("a <> b").distinct(), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
