"""Networks: paths by hops, routing outcomes, ports, connections."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize


def shortest_paths(edges: DataFrame) -> DataFrame:
    """``src, dst, hops, latency_ms, path`` for each connected pair: the fewest hops, of such paths the least by its nodes.

    A frontier grows by one hop a round and keeps pairs not reached before; each
    round joins the frontier, not all pairs, with the edges, and writes the new
    paths only. All pairs are the result, so it is as large as they are.
    """
    best = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("latency_ms").alias("latency_ms"))
    step = best.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("latency_ms").alias("more"))
    rounds = [materialize(best.select("src", "dst", F.lit(1).alias("hops"), F.col("latency_ms").cast("long").alias("latency_ms"), F.array("src", "dst").alias("path")), "frontier")]
    while True:
        hops, reached = len(rounds) + 1, functools.reduce(DataFrame.unionByName, (r.select("src", "dst") for r in rounds))
        grown = rounds[-1].join(step, F.col("dst") == F.col("mid")).filter("src <> to")
        grown = grown.select("src", F.col("to").alias("dst"), F.lit(hops).alias("hops"), (F.col("latency_ms") + F.col("more")).alias("latency_ms"), F.concat("path", F.array("to")).alias("path"))
        new = grown.groupBy("src", "dst").agg(F.min(F.struct("path", "hops", "latency_ms")).alias("p")).select("src", "dst", "p.hops", "p.latency_ms", "p.path")
        frontier = materialize(new.join(reached, ["src", "dst"], "left_anti"), "frontier")
        if frontier.isEmpty():
            discard(frontier)
            return functools.reduce(DataFrame.unionByName, rounds)
        rounds.append(frontier)


def route_outcomes(messages: DataFrame, paths: DataFrame, nodes: DataFrame, seed: int = 42) -> DataFrame:
    """Each message's fate: unknown node, no path, or delivered after its path's latency."""
    n = nodes.select("node")
    j = messages.join(n.withColumnRenamed("node", "src").withColumn("_s", F.lit(True)), "src", "left").join(n.withColumnRenamed("node", "dst").withColumn("_d", F.lit(True)), "dst", "left").join(paths.select("src", "dst", "hops", F.col("latency_ms").alias("_l")), ["src", "dst"], "left")
    same = F.col("src") == F.col("dst")
    outcome = F.when(F.col("_s").isNull() | F.col("_d").isNull(), "unknown_node").when(~same & F.col("hops").isNull(), "no_path").otherwise("delivered")
    return j.select("msg_id", outcome.alias("outcome"), F.when(outcome == "delivered", F.when(same, 0).otherwise(F.col("_l"))).cast("long").alias("latency_ms"))


def path_reliability(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The expected share of messages that pass: the product of reliabilities along the path."""
    hops = paths.select("src", "dst", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS a, path[i] AS b))")).alias("e"))
    rel = edges.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.max("reliability").alias("r"))
    return hops.select("src", "dst", "e.*").join(rel, ["a", "b"]).groupBy("src", "dst").agg(F.product("r").alias("reliability"))


def ephemeral_port(used: DataFrame, low: int = 49152, high: int = 65535) -> DataFrame:
    """The lowest free port of each node: the first gap in its used ports."""
    u = used.filter(F.col("port").between(low, high)).select("node", "port").distinct()
    w = Window.partitionBy("node").orderBy("port")
    run = u.withColumn("_k", F.row_number().over(w)).filter(F.col("port") == F.col("_k") + low - 1).groupBy("node").agg(F.max("port").alias("_p"))
    nodes = used.select("node").distinct()
    p = F.coalesce(F.col("_p") + 1, F.lit(low))
    return nodes.join(run, "node", "left").select("node", F.when(p <= high, p).cast("long").alias("port"))


def pool_kept(connections: DataFrame, capacity: int) -> DataFrame:
    """Connections that an endpoint's pool keeps: the most recently used up to its capacity."""
    w = Window.partitionBy("endpoint").orderBy(F.col("last_used").desc(), "conn_id")
    return connections.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= capacity).select("endpoint", "conn_id", "place")


def idle_sessions(activity: DataFrame, limit_s: int) -> DataFrame:
    """Sessions of each connection: a pause of ``limit_s`` seconds or more closes one."""
    w = Window.partitionBy("conn").orderBy("ts", "seq")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    s = activity.withColumn("_new", F.when(gap.isNull() | (gap >= limit_s * 1_000_000), 1).otherwise(0))
    s = s.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("conn", "session").agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"))


def connection_totals(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy("conn").agg(F.sum("bytes").cast("long").alias("bytes"), F.count(F.lit(1)).alias("messages"), F.max("seq").alias("last_seq"))


def queues(messages: DataFrame) -> DataFrame:
    """Place of each message in its destination's queue, first come first served."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("arrival", "msg_id")))


def without_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The network after nodes were removed, with all edges in and out of them."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)
