"""Majorities, votes, quorum health and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority_match(progress: DataFrame) -> DataFrame:
    """Per cluster the largest index that a majority holds: the match index at place floor(n / 2) (from 0) in descending order."""
    ranked = F.sort_array(F.collect_list("match_index"), asc=False)
    return progress.groupBy("cluster_id").agg(ranked.alias("_m")).select("cluster_id", F.get("_m", F.floor(F.size("_m") / 2).cast("int")).alias("majority_index"))


def commit_index(progress: DataFrame, log: DataFrame, current_term: int, commit: int = 0) -> DataFrame:
    """Per cluster the new commit index: the last entry of the current term that a majority holds; else it stays. A term's entries follow each other without a gap, so its first and last one say which it has."""
    own = log.filter(F.col("term") == current_term).agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"))
    m = majority_match(progress).crossJoin(F.broadcast(own))  # one row
    n = F.when(F.col("majority_index") >= F.col("_a"), F.least("majority_index", "_b"))
    return m.select("cluster_id", F.greatest(F.coalesce(n, F.lit(commit)), F.lit(commit)).cast("long").alias("commit_index"))


def joint_commit(old: DataFrame, new: DataFrame) -> DataFrame:
    """With two configurations at once the lesser of their majority indices commits."""
    a, b = majority_match(old).withColumnRenamed("majority_index", "old_index"), majority_match(new).withColumnRenamed("majority_index", "new_index")
    return a.join(b, "cluster_id").select("cluster_id", F.least("old_index", "new_index").alias("commit_index"))


def vote_tally(responses: DataFrame, voters: int) -> DataFrame:
    """Per term and candidate the distinct voters that granted, and whether they are over half of all voters."""
    granted = F.count_distinct(F.when(F.col("vote_granted"), F.col("voter_id")))
    return responses.groupBy("term", "candidate_id").agg(granted.alias("granted"), F.count_distinct("voter_id").alias("answers")).withColumn("elected", F.col("granted") * 2 > voters)


def step_down(responses: DataFrame, current_term: int) -> DataFrame:
    """Whether any answer shows a higher term, per candidate."""
    return responses.groupBy("candidate_id").agg(F.max("term").alias("highest_term"), F.bool_or(F.col("term") > current_term).alias("steps_down"))


def read_quorum(acks: DataFrame) -> DataFrame:
    """Linearizable reads: (followers + 1) div 2 acknowledgements are needed."""
    need = F.expr("(count(*) + 1) div 2")
    return acks.groupBy("read_id").agg(F.count_if("success").alias("acks"), need.alias("needed")).withColumn("valid", F.col("acks") >= F.col("needed"))


def collect_majority(answers: DataFrame) -> DataFrame:
    """A majority of the futures asked, n div 2 + 1, must return a value, whatever it says."""
    return answers.groupBy("request_id").agg(F.count_if("returned").alias("returned"), F.expr("count(*) div 2 + 1").alias("needed")).withColumn("ok", F.col("returned") >= F.col("needed"))


def first_successes(answers: DataFrame, n: int) -> DataFrame:
    """The first ``n`` successes of each request by finishing time; requests that can't have as many give none."""
    rn = F.row_number().over(Window.partitionBy("request_id").orderBy("finished", "answer_id"))
    w = Window.partitionBy("request_id")
    ok = answers.filter("returned").withColumn("place", rn).withColumn("_n", F.count(F.lit(1)).over(w))
    return ok.filter((F.col("place") <= n) & (F.col("_n") >= n)).select("request_id", "answer_id", "place")


def first_success(answers: DataFrame) -> DataFrame:
    return answers.filter("returned").groupBy("request_id").agg(F.min(F.struct("finished", "answer_id")).alias("f")).select("request_id", F.col("f.answer_id").alias("answer_id"))


def slow_followers(progress: DataFrame, log: DataFrame, lag: int = 100) -> DataFrame:
    """Followers that are more than ``lag`` entries behind the log's last one."""
    last = F.broadcast(log.agg(F.max("idx").alias("_last")))
    return progress.crossJoin(last).select("node_id", (F.col("_last") - F.col("match_index")).alias("lag")).filter(F.col("lag") > lag)


def joint_tally(responses: DataFrame) -> DataFrame:
    """Per term and candidate the distinct voters of the old and the new configuration (``in_old, in_new``) that granted, of how many that answered; elected only by a majority of both."""
    def voters(*tests):
        test = F.lit(True)
        for t in tests:
            test = test & F.col(t)
        return F.count_distinct(F.when(test, F.col("voter_id")))

    g = responses.groupBy("term", "candidate_id").agg(voters("in_old", "vote_granted").alias("old_granted"), voters("in_old").alias("old_voters"), voters("in_new", "vote_granted").alias("new_granted"), voters("in_new").alias("new_voters"))
    return g.withColumn("elected", (F.col("old_granted") * 2 > F.col("old_voters")) & (F.col("new_granted") * 2 > F.col("new_voters")))


def status(total: Column, live: Column) -> Column:
    need = F.floor(total / 2) + 1
    return F.when(total == 0, "healthy").when(live < need, "lost").when(live == need, "critical").when(live < total, "degraded").otherwise("healthy")


def quorum_status(placement: DataFrame) -> DataFrame:
    g = placement.groupBy("group_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("live").alias("live_count"))
    # A quorum that is just met is critical also if all are alive in a group of one.
    return g.withColumn("status", status(F.col("total"), F.col("live_count")))


def group_health(placement: DataFrame, targets: DataFrame) -> DataFrame:
    """Live nodes, target and the unreachable ones of every group that has a target, also of empty ones."""
    g = placement.groupBy("group_id").agg(F.count_if("live").alias("live_count"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("live"), F.col("node_id")))).cast("array<string>"), ",").alias("unreachable"))
    return targets.join(g, "group_id", "left").select("group_id", "target_count", F.coalesce("live_count", F.lit(0)).alias("live_count"), F.coalesce("unreachable", F.lit("")).alias("unreachable"))


def placement_counts(members: DataFrame) -> DataFrame:
    """Voters, learners and both per group (``group_id, is_learner``); no group counts as the empty one."""
    return members.groupBy(F.coalesce("group_id", F.lit("")).alias("group_id")).agg(F.count_if(~F.col("is_learner")).alias("voters"), F.count_if("is_learner").alias("learners"), F.count(F.lit(1)).alias("members"))


def capacity(members: DataFrame, targets: DataFrame) -> DataFrame:
    """May a group take a learner (its own cap if set, else the shared target), and promote one (fewer voters than the target)?"""
    c = targets.join(placement_counts(members), "group_id", "left").fillna(0, ["voters", "learners", "members"])
    admit = F.when(F.col("learner_capacity").isNotNull(), F.col("learners") < F.col("learner_capacity")).otherwise(F.col("members") < F.col("target_count"))
    return c.select("group_id", "voters", "learners", admit.alias("can_admit"), (F.col("voters") < F.col("target_count")).alias("can_promote"))


def deficit(placement: DataFrame, targets: DataFrame, pending: DataFrame) -> DataFrame:
    """Nodes to provision per group: target less live less pending, never below zero."""
    live = placement.groupBy("group_id").agg(F.count_if("live").alias("live_count"))
    wait = pending.groupBy("group_id").agg(F.count(F.lit(1)).alias("pending"))
    j = targets.join(live, "group_id", "left").join(wait, "group_id", "left").fillna(0, ["live_count", "pending"])
    return j.select("group_id", F.greatest(F.col("target_count") - F.col("live_count") - F.col("pending"), F.lit(0)).cast("long").alias("deficit"))
