"""Replicated logs: reads, differences, replication plans, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ENTRIES = 100
CHUNK_BYTES = 1_000_000


def entry_range(log: DataFrame, first: int, last: int) -> DataFrame:
    return log.filter(F.col("idx").between(first, last))


def last_index(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last_index"))


def truncate_suffix(log: DataFrame, idx: int) -> DataFrame:
    return log.filter(F.col("idx") < idx)


def delete_prefix(log: DataFrame, idx: int) -> DataFrame:
    return log.filter(F.col("idx") >= idx)


def upsert(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new entries, a later write of an index replacing the earlier one."""
    both = log.withColumn("_w", F.lit(0)).unionByName(new.withColumn("_w", F.lit(1)))
    cols = [c for c in log.columns if c != "idx"]
    return both.groupBy("idx").agg(F.max_by(F.struct(*cols), "_w").alias("_e")).select("idx", *(F.col(f"_e.{c}").alias(c) for c in cols))


def compaction(log: DataFrame, last_included: int) -> DataFrame:
    """Entries removed and kept by a snapshot up to an index, per term."""
    return log.groupBy("term").agg(F.count_if(F.col("idx") <= last_included).alias("removed"), F.count_if(F.col("idx") > last_included).alias("kept"))


def term_runs(log: DataFrame) -> DataFrame:
    """First and last index of each run of one term in a node's log (terms never decrease along a log)."""
    return log.groupBy("node_id", "term").agg(F.min("idx").alias("first_index"), F.max("idx").alias("last_index"))


def consistency(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Follower replies to ``(node_id, prev_index, prev_term)``: success, or where to go back to.

    A log that is too short answers its last index + 1 and no term; another term
    answers the first index of that term's run.
    """
    ends = log.groupBy("node_id").agg(F.max("idx").alias("last_index"))
    at = log.select("node_id", F.col("idx").alias("prev_index"), F.col("term").alias("own_term"))
    runs = log.groupBy("node_id", F.col("term").alias("own_term")).agg(F.min("idx").alias("first_index"))
    j = requests.join(at, ["node_id", "prev_index"], "left").join(ends, "node_id", "left").join(runs, ["node_id", "own_term"], "left")
    success = (F.col("prev_index") == 0) | F.coalesce(F.col("own_term") == F.col("prev_term"), F.lit(False))
    hint = F.when(success, None).when(F.col("own_term").isNull(), F.coalesce(F.col("last_index"), F.lit(0)) + 1).otherwise(F.col("first_index"))
    return j.select("node_id", "prev_index", "prev_term", success.alias("success"), hint.alias("conflict_index"), F.when(~success, F.col("own_term")).alias("conflict_term"))


def first_conflict(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first index at which two logs hold different terms."""
    return a.alias("a").join(b.alias("b"), "idx").filter("a.term <> b.term").agg(F.min("idx").alias("conflict_index"))


def conflict_truncate(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """The follower's log after it took the leader's: its prefix before the first conflict, then the leader's entries that it lacks."""
    cut = F.broadcast(first_conflict(follower, leader))
    own = follower.crossJoin(cut).filter(F.col("conflict_index").isNull() | (F.col("idx") < F.col("conflict_index"))).drop("conflict_index")
    new = leader.join(own, "idx", "left_anti")
    return own.unionByName(new)


def next_batch(progress: DataFrame, log: DataFrame, first_index: int, limit: int = MAX_ENTRIES) -> DataFrame:
    """Per peer (``node_id, next_index``) what to send: the range of at most ``limit`` entries, or a snapshot if the entry before them is compacted."""
    last = F.broadcast(log.agg(F.max("idx").alias("last_index")))
    p = progress.crossJoin(last)
    snap = F.col("next_index") < first_index
    end = F.least(F.col("last_index"), F.col("next_index") + limit - 1)
    n = F.when(snap, 0).otherwise(F.greatest(end - F.col("next_index") + 1, F.lit(0)))
    return p.select("node_id", "next_index", snap.alias("needs_snapshot"), n.cast("long").alias("n_entries"), F.when(n > 0, end).cast("long").alias("last_sent"))


def progress_update(responses: DataFrame) -> DataFrame:
    """Match and next index after a response (``node_id, next_index, n_entries, success, conflict_index``)."""
    ok = F.col("success")
    back = F.greatest(F.lit(1), F.coalesce("conflict_index", F.col("next_index") - 1))
    return responses.select("node_id", F.when(ok, F.col("next_index") + F.col("n_entries") - 1).cast("long").alias("match_index"), F.when(ok, F.col("next_index") + F.col("n_entries")).otherwise(back).cast("long").alias("next_index"))


def chunks(snapshots: DataFrame, size: Column, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of each snapshot: number, offset, length, done. An empty one has one empty, last chunk."""
    n = F.greatest(F.ceil(size / chunk), F.lit(1)).cast("int")
    e = snapshots.withColumn("_size", size).withColumn("_n", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    offset = F.col("chunk").cast("long") * chunk
    return e.withColumns({"offset": offset, "length": F.least(F.lit(chunk), F.col("_size") - offset).cast("long"), "done": F.col("chunk") == F.col("_n") - 1}).drop("_size", "_n")


def reassembly(parts: DataFrame) -> DataFrame:
    """Per transfer whether each chunk starts where the ones before it end, and the size."""
    w = Window.partitionBy("transfer_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    held = parts.withColumn("_held", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return held.groupBy("transfer_id").agg(F.bool_and(F.col("offset") == F.col("_held")).alias("complete"), F.sum("length").cast("long").alias("size"))


def fetch_range(requests: DataFrame, log: DataFrame, block: int = 1024) -> DataFrame:
    """For ``(req_id, from_index, to_index)``: the entries served, from the first on and up to the first gap; none if the first isn't held."""
    # Requests meet entries by blocks of indices.
    asked = requests.withColumn("_block", F.explode(F.sequence(F.floor(F.col("from_index") / block), F.floor(F.greatest("from_index", "to_index") / block))))
    held = asked.join(log.select("idx", F.floor(F.col("idx") / block).alias("_block")), "_block").filter(F.col("idx").between(F.col("from_index"), F.col("to_index")))
    # Without a gap the k-th entry held is from_index + k - 1.
    rn = F.row_number().over(Window.partitionBy("req_id").orderBy("idx"))
    run = held.withColumn("_rn", rn).filter(F.col("idx") == F.col("from_index") + F.col("_rn") - 1).groupBy("req_id").agg(F.count(F.lit(1)).alias("n_entries"), F.max("idx").alias("last_served"))
    prev = log.select((F.col("idx") + 1).alias("from_index"), F.col("term").alias("prev_term"))
    out = requests.join(run, "req_id", "left").join(prev, "from_index", "left")
    return out.select("req_id", F.col("n_entries").isNotNull().alias("available"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), "last_served", F.coalesce("prev_term", F.lit(0)).cast("long").alias("prev_term"))


def latest_configuration(log: DataFrame, boot: str) -> DataFrame:
    """The last configuration entry's command and index, or the boot configuration."""
    return log.agg(F.coalesce(F.max_by(F.when(F.col("entry_type") == 1, F.col("command")), F.when(F.col("entry_type") == 1, F.col("idx"))), F.lit(boot)).alias("configuration"), F.coalesce(F.max(F.when(F.col("entry_type") == 1, F.col("idx"))), F.lit(0)).alias("idx"))


def configuration_phases(log: DataFrame) -> DataFrame:
    """Configuration entries in pairs: a joint one, then the final one, with the entry that each follows."""
    w = Window.orderBy("idx")  # configuration entries only: a log has few
    c = log.filter("entry_type = 1").withColumn("_n", F.row_number().over(w))
    return c.select("idx", F.when(F.col("_n") % 2 == 1, "joint").otherwise("final").alias("phase"), F.lag("idx").over(w).alias("after"))


def follower_commit(progress: DataFrame, leader_commit: int) -> DataFrame:
    return progress.select("node_id", F.least(F.lit(leader_commit).cast("long"), F.col("match_index")).alias("commit_index"))
