"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """Each of ``total`` pairs (u, v) with m, the least of u and all its neighbours v. The pairs of a hub are dealt over all tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(pairs, least, ["u"], "n", total, "v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes that have an edge, with the least node reachable.

    ``edges``: two columns of one orderable type; order within a pair, repeats
    and self-loops don't matter, rows with a null are no edges. Returns
    ``node, root``; an empty table for no edges. The number of rounds grows
    with the logarithm of the number of nodes; each is written to the shared
    folder, and the one before it deleted.
    """
    e = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("x") != F.col("y")))
    e = materialize(e.distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("y", "x").bitwiseAND(0xFFFFFFFF)))
    before = e.agg(mark).first()[0]
    while before[0]:
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
        large = _star(both, 2 * before[0]).filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        down = large.select(F.col("x").alias("u"), F.col("y").alias("v"))
        small = _star(down, before[0]).select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("p")).select("p.*")
        e, last = materialize(small.filter("x <> y").distinct(), "edges"), e
        discard(last)
        after = e.agg(mark).first()[0]
        if after == before:
            break
        before = after
    nodes = e.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return nodes.union(e.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
