"""Membership, leadership and timeouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def is_member(node: Column, nodes: Column, old_nodes: Column, joint: Column) -> Column:
    """In the configuration's nodes, or in the old ones while both count."""
    return F.array_contains(nodes, node) | F.coalesce(joint & F.array_contains(F.coalesce(old_nodes, F.array().cast("array<bigint>")), node), F.lit(False))


def up_to_date(last_term: Column, last_index: Column, own_term: Column, own_index: Column) -> Column:
    """A candidate's log is at least as new as one's own: by term, then index."""
    return F.struct(last_term.alias("t"), last_index.alias("i")) >= F.struct(own_term.alias("t"), own_index.alias("i"))


def changes(configurations: DataFrame) -> DataFrame:
    """Nodes that joined and left with each configuration of a cluster (``cluster_id, idx, nodes``)."""
    prev = F.coalesce(F.lag("nodes").over(Window.partitionBy("cluster_id").orderBy("idx")), F.array().cast("array<bigint>"))
    text = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ",")
    return configurations.select("cluster_id", "idx", text(F.array_except("nodes", prev)).alias("joined"), text(F.array_except(prev, F.col("nodes"))).alias("left"))


def candidate_terms(states: DataFrame) -> DataFrame:
    """Each node's term when it becomes a candidate: one more than before."""
    w = Window.partitionBy("node_id").orderBy("seq")
    return states.withColumn("_p", F.lag("term").over(w)).filter("state = 'candidate'").select("node_id", "seq", (F.coalesce("_p", F.lit(0)) + 1).alias("new_term"))


def new_leader(log: DataFrame, term: int, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new leader's log, with a no-op of its term at the end, and its progress table: next is the last index + 1, match is 0."""
    last = log.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last"))
    noop = last.select((F.col("last") + 1).alias("idx"), F.lit(term).cast("long").alias("term"), F.lit(2).alias("entry_type"), F.lit("").alias("command"))
    progress = members.select("node_id").distinct().crossJoin(F.broadcast(last)).select("node_id", (F.col("last") + 1).alias("next_index"), F.lit(0).cast("long").alias("match_index"))
    return log.select("idx", "term", "entry_type", "command").unionByName(noop), progress


def timed_out(contacts: DataFrame, limit_us: int) -> DataFrame:
    """Contacts that come after more than a node's election timeout."""
    gap = F.col("at_us") - F.lag("at_us").over(Window.partitionBy("node_id").orderBy("at_us", "seq"))
    return contacts.withColumn("gap_us", gap).filter(F.col("gap_us") > limit_us).select("node_id", "seq", "gap_us")


def election_timeout(node: Column, term: Column, low: int, high: int) -> Column:
    """A timeout in [low, high] from a hash of node and term: the same in every run."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", node.cast("string"), term.cast("string"))), 1, 8), 16, 10).cast("long")
    return low + h % (high - low + 1)


def committed_delta(commits: DataFrame) -> DataFrame:
    """Entries that each advance of a cluster's commit index adds."""
    prev = F.lag("commit_index").over(Window.partitionBy("cluster_id").orderBy("seq"))
    return commits.select("cluster_id", "seq", (F.col("commit_index") - F.coalesce(prev, F.lit(0))).alias("committed"))


def liveness(placement: DataFrame, seen: DataFrame) -> DataFrame:
    """Placed nodes and whether they are alive; one that no answer names isn't."""
    return placement.select("node_id", "group_id").join(seen, "node_id", "left").select("node_id", "group_id", F.coalesce("running", F.lit(False)).alias("live"))


def installed(log: DataFrame, snapshots: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Each node's log after a snapshot: entries after it stay if the node held its last entry with the same term, else none do.

    Entries meet snapshots by node and block of ``block`` indices: a node's log may be of any length. The blocks are
    written first, so that their size is known: a few are broadcast and the log isn't shuffled, many aren't.
    """
    in_block = F.floor(F.col("idx") / block).alias("_block")
    at = log.select("node_id", F.col("idx").alias("last_included_index"), F.col("term").alias("last_included_term"))
    held = snapshots.select("node_id", "last_included_index", "last_included_term").join(at, ["node_id", "last_included_index", "last_included_term"])
    after = held.select("node_id", F.col("last_included_index").alias("_last"))
    # Of the log's blocks, a row each, those from the snapshot's last entry on.
    blocks = log.select("node_id", in_block).distinct().join(after, "node_id").filter(F.col("_block") >= F.floor(F.col("_last") / block))
    blocks = materialize(blocks, "snapshot_blocks")
    return log.select("node_id", "idx", "term", in_block).join(blocks, ["node_id", "_block"]).filter("idx > _last").select("node_id", "idx", "term")


def stale_terms(messages: DataFrame) -> DataFrame:
    """Messages (``node_id, seq, term``) and whether the node refuses them: their term is below the highest that it saw before."""
    before = F.max("term").over(Window.partitionBy("node_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return messages.select("node_id", "seq", "term", F.coalesce(F.col("term") < before, F.lit(False)).alias("refused"))


def pre_votes(events: DataFrame, timeout_us: int) -> DataFrame:
    """Answers to pre-vote requests among a node's ``events`` (``node_id, seq, at_us, kind, up_to_date``): granted if the candidate's log is new enough and no leader was heard for the election timeout. Asking changes nothing."""
    heard = F.last(F.when(F.col("kind") == "heartbeat", F.col("at_us")), ignorenulls=True).over(Window.partitionBy("node_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    sticky = F.coalesce(F.col("at_us") - heard < timeout_us, F.lit(False))
    return events.withColumn("_sticky", sticky).filter("kind = 'pre_vote'").select("node_id", "seq", F.col("_sticky").alias("leader_known"), (~F.col("_sticky") & F.col("up_to_date")).alias("granted"))


def voters_only(responses: DataFrame, members: DataFrame) -> DataFrame:
    """Responses of voting members; learners and strangers don't count."""
    return responses.join(members.filter("NOT is_learner").select(F.col("node_id").alias("voter_id")), "voter_id", "left_semi")


def pending_outside(progress: DataFrame, members: DataFrame) -> DataFrame:
    """Peers with progress that are no members any more."""
    return progress.join(members.select("node_id"), "node_id", "left_anti")
