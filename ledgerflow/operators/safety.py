"""Safety of a replicated log: each check returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def elections(states: DataFrame) -> DataFrame:
    """Terms with more than one leader (``term, node_id, is_leader``)."""
    return states.groupBy("term").agg(F.count_distinct(F.when(F.col("is_leader"), F.col("node_id"))).alias("leaders")).filter("leaders > 1")


def log_matching(logs: DataFrame) -> DataFrame:
    """Indices at which replicas hold different entries; one pass, no join of replicas with each other."""
    g = logs.groupBy("idx").agg(F.count_distinct("term", "command").alias("entries"), F.count(F.lit(1)).alias("replicas"))
    return g.filter("entries > 1").select("idx", "entries", "replicas")


def state_machines(logs: DataFrame, applied: DataFrame) -> DataFrame:
    """Indices at which nodes that both applied them have different commands (``applied``: node_id, last_applied)."""
    j = logs.join(applied, "node_id").filter("idx <= last_applied")
    return j.groupBy("idx").agg(F.count_distinct("command").alias("commands")).filter("commands > 1")


def leader_completeness(committed: DataFrame, leader_log: DataFrame) -> DataFrame:
    """Committed entries that a later leader's log lacks."""
    return committed.join(leader_log.select("idx", "term"), ["idx", "term"], "left_anti")


def leader_append_only(writes: DataFrame) -> DataFrame:
    """Writes (``leader_id, seq, idx, term, command``) that change what the leader had at that index."""
    w = Window.partitionBy("leader_id", "idx").orderBy("seq")
    prev = F.lag(F.struct("term", "command")).over(w)
    return writes.withColumn("_p", prev).filter(F.col("_p").isNotNull() & (F.col("_p") != F.struct("term", "command"))).select("leader_id", "idx", "seq")


def matching_prefix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries equal in two logs that have a differing one before them."""
    j = a.alias("a").join(b.alias("b"), "idx").select("idx", (F.col("a.term") == F.col("b.term")).alias("same"))
    first = F.broadcast(j.filter("NOT same").agg(F.min("idx").alias("first")))
    return j.crossJoin(first).filter("same AND idx > first").select("idx")


def stale_reads(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads that return less than some write of their key that had ended before they began (versions grow)."""
    w = writes.select("k", F.col("ended").alias("at"), F.lit(0).alias("_r"), F.lit(None).cast("long").alias("read_id"), F.lit(None).cast("long").alias("version"), F.col("version").alias("w"))
    r = reads.select("k", F.col("began").alias("at"), F.lit(1).alias("_r"), "read_id", "version", F.lit(None).cast("long").alias("w"))
    needed = F.max("w").over(Window.partitionBy("k").orderBy("at", "_r").rowsBetween(Window.unboundedPreceding, 0))
    return w.unionByName(r).withColumn("needed", needed).filter("_r = 1 AND version < needed").select("read_id", "version", "needed")


def commit_without_majority(logs: DataFrame, commit_index: int, nodes: int) -> DataFrame:
    """Committed indices that no majority holds."""
    g = logs.filter(F.col("idx") <= commit_index).groupBy("idx", "term").agg(F.count_distinct("node_id").alias("holders"))
    best = g.groupBy("idx").agg(F.max("holders").alias("holders"))
    return best.filter(F.col("holders") * 2 <= nodes)
