"""Queries on logs, state machines, quorums and safety."""

from pyspark.sql import functions as F

from ..operators import log, membership, quorum, replay, safety
from .registry import query

R = "ROWS UNBOUNDED PRECEDING"


@query(f"""WITH s AS (SELECT idx, cmd, sum(CASE WHEN cmd = 'RESET' THEN 1 ELSE 0 END) OVER (ORDER BY idx {R}) AS seg FROM counter_commands)
SELECT idx, cmd, CAST(sum(CASE cmd WHEN 'INC' THEN 1 WHEN 'DEC' THEN -1 ELSE 0 END) OVER (PARTITION BY seg ORDER BY idx {R}) AS BIGINT) AS value FROM s""", "counter_commands")
def counter_replay(v):
    return replay.counter(v("counter_commands"))


@query("""SELECT k, v FROM (SELECT k, v, op, row_number() OVER (PARTITION BY k ORDER BY idx DESC) AS n FROM kv_commands WHERE op <> 'get') WHERE n = 1 AND op = 'put'""", "kv_commands")
def kv_final_state(v):
    return replay.kv_final(v("kv_commands"))


@query("""WITH g AS (SELECT a.idx, a.k, max(b.idx) AS at FROM kv_commands a LEFT JOIN kv_commands b ON a.k = b.k AND b.idx < a.idx AND b.op <> 'get' WHERE a.op = 'get' GROUP BY a.idx, a.k)
SELECT g.idx, g.k, CASE WHEN c.op = 'put' THEN c.v END AS v FROM g LEFT JOIN kv_commands c ON c.idx = g.at""", "kv_commands")
def kv_get_results(v):
    return replay.kv_gets(v("kv_commands"))


@query("SELECT * FROM log_entries WHERE idx BETWEEN 100 AND 499", "log_entries")
def log_range_scan(v):
    return log.entry_range(v("log_entries"), 100, 499)


@query("SELECT coalesce(max(idx), 0) AS last_index FROM log_entries", "log_entries")
def log_last_index(v):
    return log.last_index(v("log_entries"))


@query("SELECT * FROM log_entries WHERE idx < 750", "log_entries")
def log_truncate(v):
    return log.truncate_suffix(v("log_entries"), 750)


@query("SELECT * FROM log_entries WHERE idx >= 750", "log_entries")
def log_delete_prefix(v):
    return log.delete_prefix(v("log_entries"), 750)


@query("SELECT term, sum(CASE WHEN idx <= 400 THEN 1 ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN idx > 400 THEN 1 ELSE 0 END)::BIGINT AS kept FROM log_entries GROUP BY term", "log_entries")
def log_compaction(v):
    return log.compaction(v("log_entries"), 400)


@query("""SELECT idx, CASE WHEN idx % 50 = 0 THEN term + 1 ELSE term END AS term, entry_type, CASE WHEN idx % 50 = 0 THEN 'rewritten' ELSE command END AS command FROM log_entries""", "log_entries")
def append_log_entries(v):
    new = v("log_entries").filter("idx % 50 = 0").withColumns({"term": F.col("term") + 1, "command": F.lit("rewritten")})
    return log.upsert(v("log_entries"), new)


MAJORITY = """(SELECT cluster_id, match_index AS majority_index FROM (SELECT cluster_id, match_index, row_number() OVER (PARTITION BY cluster_id ORDER BY match_index DESC) - 1 AS i,
  CAST(floor(count(*) OVER (PARTITION BY cluster_id) / 2.0) AS BIGINT) AS m FROM progress) WHERE i = m)"""


@query(f"SELECT * FROM {MAJORITY}", "progress")
def majority_match_index(v):
    return quorum.majority_match(v("progress"))


@query(f"""SELECT m.cluster_id, coalesce(max(l.idx), 0) AS commit_index FROM {MAJORITY} m LEFT JOIN log_entries l ON l.idx <= m.majority_index AND l.term = 10 GROUP BY m.cluster_id""", "progress", "log_entries")
def commit_index(v):
    return quorum.commit_index(v("progress"), v("log_entries"), 10)


@query(f"""SELECT a.cluster_id, least(a.majority_index, b.majority_index) AS commit_index FROM {MAJORITY} a JOIN {MAJORITY.replace("FROM progress", "FROM progress WHERE node_id % 2 = 0")} b USING (cluster_id)""", "progress")
def joint_commit_index(v):
    return quorum.joint_commit(v("progress"), v("progress").filter("node_id % 2 = 0"))


@query("""SELECT term, candidate_id, count(DISTINCT CASE WHEN vote_granted THEN voter_id END) AS granted, count(DISTINCT voter_id) AS answers,
  count(DISTINCT CASE WHEN vote_granted THEN voter_id END) * 2 > 60 AS elected FROM vote_responses GROUP BY term, candidate_id""", "vote_responses")
def vote_tally(v):
    return quorum.vote_tally(v("vote_responses"), 60)


@query("SELECT candidate_id, max(term) AS highest_term, bool_or(term > 48) AS steps_down FROM vote_responses GROUP BY candidate_id", "vote_responses")
def higher_term_stepdown(v):
    return quorum.step_down(v("vote_responses"), 48)


@query("SELECT node_id, last - match_index AS lag FROM progress, (SELECT max(idx) AS last FROM log_entries) WHERE last > match_index + 100", "progress", "log_entries")
def slow_followers(v):
    return quorum.slow_followers(v("progress"), v("log_entries"))


@query("""WITH r AS (SELECT *, voter_id % 3 <> 0 AS in_old, voter_id % 2 = 0 AS in_new FROM vote_responses),
g AS (SELECT term, candidate_id, count(DISTINCT CASE WHEN in_old AND vote_granted THEN voter_id END) AS old_granted, count(DISTINCT CASE WHEN in_old THEN voter_id END) AS old_voters,
  count(DISTINCT CASE WHEN in_new AND vote_granted THEN voter_id END) AS new_granted, count(DISTINCT CASE WHEN in_new THEN voter_id END) AS new_voters FROM r GROUP BY term, candidate_id)
SELECT *, old_granted > old_voters / 2.0 AND new_granted > new_voters / 2.0 AS elected FROM g""", "vote_responses")
def joint_vote_tally(v):
    return quorum.joint_tally(v("vote_responses").withColumns({"in_old": F.col("voter_id") % 3 != 0, "in_new": F.col("voter_id") % 2 == 0}))


@query("""WITH m AS (SELECT user_id AS node_id, event_id AS seq, event_id * 37 % 50 AS term FROM events)
SELECT a.node_id, a.seq, a.term, EXISTS (SELECT 1 FROM m b WHERE b.node_id = a.node_id AND b.seq < a.seq AND b.term > a.term) AS refused FROM m a""")
def stale_term_filter(v):
    return membership.stale_terms(v("events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 50).alias("term")))


PRE_VOTES = """e AS (SELECT user_id AS node_id, event_id AS seq, epoch_us(ts) AS at_us, event_type, event_id % 3 <> 0 AS up_to_date FROM events),
p AS (SELECT a.*, coalesce((SELECT max(b.seq) FROM e b WHERE b.node_id = a.node_id AND b.seq < a.seq AND b.event_type = 'view'), -1) AS heard FROM e a WHERE event_type IN ('signup', 'purchase')),
a AS (SELECT p.node_id, p.seq, coalesce(p.at_us - h.at_us < 3600000000, false) AS leader_known, p.up_to_date FROM p LEFT JOIN e h ON h.seq = p.heard)"""


def _pre_votes(v):
    kind = F.when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type").isin("signup", "purchase"), "pre_vote")
    e = v("events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), kind.alias("kind"), (F.col("event_id") % 3 != 0).alias("up_to_date"))
    return membership.pre_votes(e, 3_600_000_000)


@query(f"WITH {PRE_VOTES} SELECT node_id, seq, leader_known, NOT leader_known AND up_to_date AS granted FROM a")
def leader_stickiness(v):
    return _pre_votes(v)


@query(f"WITH {PRE_VOTES} SELECT seq % 20 AS term, seq % 3 AS candidate_id, count(DISTINCT CASE WHEN NOT leader_known AND up_to_date THEN node_id END) AS granted, count(DISTINCT node_id) AS answers, count(DISTINCT CASE WHEN NOT leader_known AND up_to_date THEN node_id END) * 2 > 5 AS elected FROM a GROUP BY ALL")
def pre_vote_tally(v):
    r = _pre_votes(v).select((F.col("seq") % 20).alias("term"), (F.col("seq") % 3).alias("candidate_id"), F.col("node_id").alias("voter_id"), F.col("granted").alias("vote_granted"))
    return quorum.vote_tally(r, 5)


@query("SELECT term, candidate_id, voter_id, vote_granted FROM vote_responses WHERE voter_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1)", "vote_responses")
def learner_filter(v):
    return membership.voters_only(v("vote_responses"), v("customer").select(F.col("c_custkey").alias("node_id"), (F.col("c_custkey") % 4 == 1).alias("is_learner"))).select("term", "candidate_id", "voter_id", "vote_granted")


@query("""SELECT term AS read_id, sum(CASE WHEN vote_granted THEN 1 ELSE 0 END)::BIGINT AS acks, CAST(floor((count(*) + 1) / 2.0) AS BIGINT) AS needed,
  sum(CASE WHEN vote_granted THEN 1 ELSE 0 END) >= floor((count(*) + 1) / 2.0) AS valid FROM vote_responses GROUP BY term""", "vote_responses")
def read_quorum(v):
    return quorum.read_quorum(v("vote_responses").select(F.col("term").alias("read_id"), F.col("vote_granted").alias("success")))


def _answers(v):
    return v("vote_responses").select(F.col("term").alias("request_id"), F.col("voter_id").alias("answer_id"), F.col("vote_granted").alias("returned"), (F.col("voter_id") * 31 % 97).alias("finished")).distinct()


ANSWERS = "a AS (SELECT DISTINCT term AS request_id, voter_id AS answer_id, vote_granted AS returned, voter_id * 31 % 97 AS finished FROM vote_responses)"


@query(f"WITH {ANSWERS} SELECT request_id, sum(CASE WHEN returned THEN 1 ELSE 0 END)::BIGINT AS returned, CAST(floor(count(*) / 2.0) AS BIGINT) + 1 AS needed, sum(CASE WHEN returned THEN 1 ELSE 0 END) >= floor(count(*) / 2.0) + 1 AS ok FROM a GROUP BY request_id", "vote_responses")
def collect_majority(v):
    return quorum.collect_majority(_answers(v))


@query(f"WITH {ANSWERS}, s AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY finished, answer_id) AS place, count(*) OVER (PARTITION BY request_id) AS n FROM a WHERE returned) SELECT request_id, answer_id, place FROM s WHERE place <= 5 AND n >= 5", "vote_responses")
def collect_n_successes(v):
    return quorum.first_successes(_answers(v), 5)


@query(f"WITH {ANSWERS}, s AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY finished, answer_id) AS place FROM a WHERE returned) SELECT request_id, answer_id FROM s WHERE place = 1", "vote_responses")
def collect_any(v):
    return quorum.first_success(_answers(v))


STATUS = "CASE WHEN total = 0 THEN 'healthy' WHEN live_count < floor(total / 2.0) + 1 THEN 'lost' WHEN live_count = floor(total / 2.0) + 1 THEN 'critical' WHEN live_count < total THEN 'degraded' ELSE 'healthy' END"


@query(f"WITH g AS (SELECT group_id, count(*) AS total, sum(CASE WHEN live THEN 1 ELSE 0 END)::BIGINT AS live_count FROM placement GROUP BY group_id) SELECT *, {STATUS} AS status FROM g", "placement")
def quorum_status(v):
    return quorum.quorum_status(v("placement"))


@query("""SELECT t.group_id, t.target_count, coalesce(sum(CASE WHEN p.live THEN 1 ELSE 0 END), 0)::BIGINT AS live_count, coalesce(string_agg(CASE WHEN NOT p.live THEN CAST(p.node_id AS VARCHAR) END, ',' ORDER BY p.node_id), '') AS unreachable
FROM targets t LEFT JOIN placement p USING (group_id) GROUP BY t.group_id, t.target_count""", "placement", "targets")
def group_health(v):
    return quorum.group_health(v("placement"), v("targets"))


MEMBERS = "m AS (SELECT CASE WHEN node_id % 11 = 0 THEN NULL ELSE group_id END AS group_id, node_id % 3 = 0 AS is_learner FROM placement), c AS (SELECT coalesce(group_id, '') AS group_id, sum(CASE WHEN NOT is_learner THEN 1 ELSE 0 END)::BIGINT AS voters, sum(CASE WHEN is_learner THEN 1 ELSE 0 END)::BIGINT AS learners, count(*) AS members FROM m GROUP BY 1)"


def _members(v):
    return v("placement").select(F.when(F.col("node_id") % 11 != 0, F.col("group_id")).alias("group_id"), (F.col("node_id") % 3 == 0).alias("is_learner"))


@query(f"WITH {MEMBERS} SELECT * FROM c", "placement")
def placement_counts(v):
    return quorum.placement_counts(_members(v))


@query(f"""WITH {MEMBERS} SELECT t.group_id, coalesce(voters, 0) AS voters, coalesce(learners, 0) AS learners,
  CASE WHEN learner_capacity IS NOT NULL THEN coalesce(learners, 0) < learner_capacity ELSE coalesce(members, 0) < target_count END AS can_admit, coalesce(voters, 0) < target_count AS can_promote
FROM targets t LEFT JOIN c USING (group_id)""", "placement", "targets")
def capacity_flags(v):
    return quorum.capacity(_members(v), v("targets"))


@query("""SELECT t.group_id, CAST(greatest(t.target_count - coalesce(l.n, 0) - coalesce(w.n, 0), 0) AS BIGINT) AS deficit FROM targets t
LEFT JOIN (SELECT group_id, sum(CASE WHEN live THEN 1 ELSE 0 END)::BIGINT AS n FROM placement GROUP BY 1) l USING (group_id)
LEFT JOIN (SELECT group_id, count(*) AS n FROM placement WHERE node_id % 7 = 0 GROUP BY 1) w USING (group_id)""", "placement", "targets")
def provision_deficit(v):
    return quorum.deficit(v("placement"), v("targets"), v("placement").filter("node_id % 7 = 0"))


@query("SELECT sum(target_count)::BIGINT AS desired FROM targets", "targets")
def desired_size(v):
    return v("targets").agg(F.sum("target_count").cast("long").alias("desired"))


@query("SELECT idx, count(DISTINCT (term, command)) AS entries, count(*) AS replicas FROM replica_logs GROUP BY idx HAVING count(DISTINCT (term, command)) > 1", "replica_logs")
def log_matching_violations(v):
    return safety.log_matching(v("replica_logs"))


@query("SELECT term, count(DISTINCT CASE WHEN vote_granted THEN candidate_id END) AS leaders FROM vote_responses GROUP BY term HAVING count(DISTINCT CASE WHEN vote_granted THEN candidate_id END) > 1", "vote_responses")
def election_safety_violations(v):
    return safety.elections(v("vote_responses").select("term", F.col("candidate_id").alias("node_id"), F.col("vote_granted").alias("is_leader")))


DIVERGED = "d AS (SELECT node_id, idx, term, CASE WHEN node_id = 1 AND idx % 113 = 0 THEN 'other' ELSE command END AS command FROM replica_logs)"


def _diverged(v):
    return v("replica_logs").withColumn("command", F.when((F.col("node_id") == 1) & (F.col("idx") % 113 == 0), "other").otherwise(F.col("command")))


@query(f"WITH {DIVERGED} SELECT idx, count(DISTINCT command) AS commands FROM d WHERE idx <= 900 - 100 * node_id GROUP BY idx HAVING count(DISTINCT command) > 1", "replica_logs")
def state_machine_safety_violations(v):
    applied = v("replica_logs").select("node_id").distinct().withColumn("last_applied", 900 - 100 * F.col("node_id"))
    return safety.state_machines(_diverged(v), applied)


@query("SELECT l.idx, l.term, l.command FROM log_entries l WHERE NOT EXISTS (SELECT 1 FROM replica_logs r WHERE r.node_id = 2 AND r.idx = l.idx AND r.term = l.term)", "log_entries", "replica_logs")
def leader_completeness_violations(v):
    return safety.leader_completeness(v("log_entries").select("idx", "term", "command"), v("replica_logs").filter("node_id = 2"))


@query(f"""WITH {DIVERGED}, w AS (SELECT node_id, idx, term, command, lag(term) OVER (PARTITION BY idx ORDER BY node_id) AS pt, lag(command) OVER (PARTITION BY idx ORDER BY node_id) AS pc FROM d)
SELECT 1 AS leader_id, idx, CAST(node_id AS BIGINT) AS seq FROM w WHERE pt IS NOT NULL AND (pt <> term OR pc <> command)""", "replica_logs")
def leader_append_only_violations(v):
    return safety.leader_append_only(_diverged(v).select(F.lit(1).alias("leader_id"), F.col("node_id").cast("long").alias("seq"), "idx", "term", "command"))


@query("""WITH j AS (SELECT a.idx, a.term = b.term AS same FROM replica_logs a JOIN replica_logs b ON a.idx = b.idx AND a.node_id = 0 AND b.node_id = 2)
SELECT idx FROM j WHERE same AND idx > (SELECT min(idx) FROM j WHERE NOT same)""", "replica_logs")
def matching_prefix_violations(v):
    r = v("replica_logs")
    return safety.matching_prefix(r.filter("node_id = 0"), r.filter("node_id = 2"))


@query("""WITH w AS (SELECT k, idx AS version, idx + 5 AS ended FROM kv_commands WHERE op = 'put'), r AS (SELECT idx AS read_id, k, idx - 60 AS version, idx AS began FROM kv_commands WHERE op = 'get')
SELECT read_id, r.version, max(w.version) AS needed FROM r JOIN w USING (k) WHERE ended <= began GROUP BY read_id, r.version HAVING r.version < max(w.version)""", "kv_commands")
def linearizable_read_violations(v):
    c = v("kv_commands")
    return safety.stale_reads(c.filter("op = 'put'").select("k", F.col("idx").alias("version"), (F.col("idx") + 5).alias("ended")), c.filter("op = 'get'").select(F.col("idx").alias("read_id"), "k", (F.col("idx") - 60).alias("version"), F.col("idx").alias("began")))


@query("""WITH h AS (SELECT idx, term, count(DISTINCT node_id) AS holders FROM replica_logs WHERE idx <= 800 AND NOT (node_id = 1 AND idx % 97 = 0) GROUP BY idx, term)
SELECT idx, max(holders) AS holders FROM h GROUP BY idx HAVING max(holders) * 2 <= 3""", "replica_logs")
def commit_implies_replication(v):
    return safety.commit_without_majority(v("replica_logs").filter("NOT (node_id = 1 AND idx % 97 = 0)"), 800, 3)


@query("SELECT min(a.idx) AS conflict_index FROM replica_logs a JOIN replica_logs b ON a.idx = b.idx AND a.node_id = 0 AND b.node_id = 2 AND a.term <> b.term", "replica_logs")
def conflict_index(v):
    r = v("replica_logs")
    return log.first_conflict(r.filter("node_id = 0"), r.filter("node_id = 2"))


@query("""WITH c AS (SELECT min(a.idx) AS x FROM replica_logs a JOIN replica_logs b ON a.idx = b.idx AND a.node_id = 0 AND b.node_id = 2 AND a.term <> b.term)
SELECT idx, term, command FROM replica_logs WHERE node_id = 2 AND idx < (SELECT x FROM c) UNION ALL SELECT idx, term, command FROM replica_logs WHERE node_id = 0 AND idx >= (SELECT x FROM c)""", "replica_logs")
def conflict_truncate(v):
    r = v("replica_logs")
    return log.conflict_truncate(r.filter("node_id = 2").select("idx", "term", "command"), r.filter("node_id = 0").select("idx", "term", "command"))


@query("""WITH q AS (SELECT CAST(node_id AS BIGINT) AS node_id, x * 333 AS prev_index, 1 + CAST(floor((x * 333 - 1) / 100.0) AS BIGINT) + x % 2 AS prev_term FROM (SELECT DISTINCT node_id FROM replica_logs) CROSS JOIN (SELECT 1 AS x UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 100000)),
o AS (SELECT node_id, idx, term, min(idx) OVER (PARTITION BY node_id, term) AS first_index, max(idx) OVER (PARTITION BY node_id) AS last_index FROM replica_logs)
SELECT q.node_id, prev_index, prev_term, coalesce(o.term = prev_term, false) AS success,
  CASE WHEN coalesce(o.term = prev_term, false) THEN NULL WHEN o.term IS NULL THEN (SELECT max(last_index) FROM o x WHERE x.node_id = q.node_id) + 1 ELSE o.first_index END AS conflict_index,
  CASE WHEN NOT coalesce(o.term = prev_term, false) THEN o.term END AS conflict_term
FROM q LEFT JOIN o ON o.node_id = q.node_id AND o.idx = q.prev_index""", "replica_logs")
def append_consistency(v):
    r = v("replica_logs").withColumn("node_id", F.col("node_id").cast("long"))
    q = r.select("node_id").distinct().withColumn("x", F.explode(F.array(*map(F.lit, (1, 2, 3, 100000)))))
    q = q.select("node_id", (F.col("x") * 333).alias("prev_index"), (1 + F.floor((F.col("x") * 333 - 1) / 100.0) + F.col("x") % 2).alias("prev_term"))
    return log.consistency(q, r)


@query("""SELECT node_id, match_index + 1 AS next_index, match_index + 1 < 500 AS needs_snapshot,
  CAST(CASE WHEN match_index + 1 < 500 THEN 0 ELSE greatest(least(m, match_index + 100) - match_index, 0) END AS BIGINT) AS n_entries,
  CASE WHEN match_index + 1 >= 500 AND least(m, match_index + 100) > match_index THEN least(m, match_index + 100) END AS last_sent
FROM progress CROSS JOIN (SELECT max(idx) AS m FROM log_entries)""", "progress", "log_entries")
def next_batch_plan(v):
    return log.next_batch(v("progress").select("node_id", (F.col("match_index") + 1).alias("next_index")), v("log_entries"), 500)


@query("""SELECT node_id, CASE WHEN node_id % 3 <> 0 THEN match_index + 10 END AS match_index,
  CASE WHEN node_id % 3 <> 0 THEN match_index + 11 ELSE greatest(1, coalesce(CASE WHEN node_id % 2 = 0 THEN match_index - 50 END, match_index)) END AS next_index FROM progress""", "progress")
def progress_update(v):
    return log.progress_update(v("progress").select("node_id", (F.col("match_index") + 1).alias("next_index"), F.lit(10).alias("n_entries"), (F.col("node_id") % 3 != 0).alias("success"), F.when(F.col("node_id") % 2 == 0, F.col("match_index") - 50).alias("conflict_index")))


@query("SELECT node_id, least(700, match_index) AS commit_index FROM progress", "progress")
def follower_commit(v):
    return log.follower_commit(v("progress"), 700)


@query("""WITH s AS (SELECT idx, size_chars, greatest(CAST(ceil(size_chars / 1000.0) AS BIGINT), 1) AS n FROM manifest_objects), c AS (SELECT idx, size_chars, n, unnest(generate_series(0, n - 1)) AS chunk FROM s)
SELECT idx, CAST(chunk AS INTEGER) AS chunk, chunk * 1000 AS "offset", least(1000, size_chars - chunk * 1000) AS length, chunk = n - 1 AS done FROM c""", "manifest_objects")
def snapshot_chunks(v):
    return log.chunks(v("manifest_objects").select("idx", "size_chars"), F.col("size_chars"), 1000).drop("size_chars")


@query("""SELECT transfer_id, bool_and("offset" = held) AS complete, sum(length)::BIGINT AS size FROM (
  SELECT user_id AS transfer_id, length, "offset", coalesce(sum(length) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM (
    SELECT user_id, event_id, 10 AS length, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 10 + CASE WHEN event_id % 701 = 0 THEN 1 ELSE 0 END AS "offset" FROM events)) GROUP BY transfer_id""")
def chunk_reassembly_check(v):
    from pyspark.sql import Window

    e = v("events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return log.reassembly(e.select(F.col("user_id").alias("transfer_id"), F.col("event_id").alias("arrival"), F.lit(10).alias("length"), (k * 10 + F.when(F.col("event_id") % 701 == 0, 1).otherwise(0)).alias("offset")))


@query("""WITH h AS (SELECT * FROM log_entries WHERE idx % 250 <> 0), q AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS req_id, user_id * 13 % 900 + 1 AS from_index, user_id * 13 % 900 + 60 AS to_index FROM events),
g AS (SELECT q.req_id, h.idx, h.idx - q.from_index + 1 - row_number() OVER (PARTITION BY q.req_id ORDER BY h.idx) AS miss FROM q JOIN h ON h.idx BETWEEN q.from_index AND q.to_index),
n AS (SELECT req_id, count(*) AS n_entries, max(idx) AS last_served FROM g WHERE miss = 0 GROUP BY req_id)
SELECT q.req_id, n.n_entries IS NOT NULL AS available, coalesce(n.n_entries, 0) AS n_entries, n.last_served, coalesce(p.term, 0) AS prev_term FROM q LEFT JOIN n USING (req_id) LEFT JOIN h p ON p.idx + 1 = q.from_index""", "log_entries")
def fetch_log_range(v):
    u = F.col("user_id")
    q = v("events").select(u.cast("long").alias("req_id"), (u * 13 % 900 + 1).alias("from_index"), (u * 13 % 900 + 60).alias("to_index")).distinct()
    return log.fetch_range(q, v("log_entries").filter("idx % 250 <> 0"))


@query("SELECT coalesce((SELECT command FROM log_entries WHERE entry_type = 1 ORDER BY idx DESC LIMIT 1), 'boot') AS configuration, coalesce((SELECT max(idx) FROM log_entries WHERE entry_type = 1), 0) AS idx", "log_entries")
def config_rescan(v):
    return log.latest_configuration(v("log_entries"), "boot")


@query("SELECT idx, CASE WHEN row_number() OVER (ORDER BY idx) % 2 = 1 THEN 'joint' ELSE 'final' END AS phase, lag(idx) OVER (ORDER BY idx) AS after FROM log_entries WHERE entry_type = 1", "log_entries")
def membership_history(v):
    return log.configuration_phases(v("log_entries"))


@query("SELECT node_id, term, min(idx) AS first_index, max(idx) AS last_index FROM replica_logs GROUP BY node_id, term", "replica_logs")
def term_runs(v):
    return log.term_runs(v("replica_logs"))


@query("""SELECT idx, term, command, CAST(floor((row_number() OVER (ORDER BY idx) - 1) / 100.0) AS BIGINT) AS batch FROM log_entries
WHERE entry_type = 0 AND idx < (SELECT min(idx) FROM log_entries WHERE entry_type = 0 AND idx % 997 = 0)""", "log_entries")
def apply_with_policy(v):
    return replay.applied(v("log_entries"), F.col("idx") % 997 == 0, "halt")


@query("""SELECT idx, term, command, CAST(floor((row_number() OVER (ORDER BY idx) - 1) / 100.0) AS BIGINT) AS batch FROM log_entries WHERE entry_type = 0 AND idx % 997 <> 0""", "log_entries")
def apply_skipping(v):
    return replay.applied(v("log_entries"), F.col("idx") % 997 == 0, "skip")


@query("""WITH RECURSIVE c AS (SELECT user_id % 20 AS register, event_id + 1 AS idx, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n, CASE event_type WHEN 'signup' THEN 'WRITE' WHEN 'view' THEN 'READ' ELSE 'CAS' END AS op,
  CAST((event_id + 1) % 3 AS VARCHAR) AS x, CAST((event_id + 2) % 3 AS VARCHAR) AS y FROM events),
r AS (SELECT register, 0::BIGINT AS idx, 0::BIGINT AS n, '' AS reply, 0::BIGINT AS version, '' AS value FROM c WHERE n = 1
  UNION ALL SELECT c.register, c.idx, c.n, CASE c.op WHEN 'WRITE' THEN 'OK' WHEN 'READ' THEN r.value ELSE CASE WHEN r.value = c.x THEN 'OK' ELSE 'FAILED' END END,
    r.version + CASE WHEN c.op = 'WRITE' OR (c.op = 'CAS' AND r.value = c.x) THEN 1 ELSE 0 END, CASE WHEN c.op = 'WRITE' THEN c.x WHEN c.op = 'CAS' AND r.value = c.x THEN c.y ELSE r.value END
  FROM r JOIN c ON c.register = r.register AND c.n = r.n + 1)
SELECT register, idx, reply, version FROM r WHERE n > 0""")
def register_cas(v):
    c = v("events").select((F.col("user_id") % 20).alias("register"), (F.col("event_id") + 1).alias("idx"), "event_type", F.col("value").cast("int").cast("string").alias("x"))
    cmd = F.when(F.col("event_type") == "signup", F.concat(F.lit("WRITE "), F.expr("string(idx % 3)"))).when(F.col("event_type") == "view", "READ").otherwise(F.concat_ws(" ", F.lit("CAS"), F.expr("string(idx % 3)"), F.expr("string((idx + 1) % 3)")))
    return replay.register_cas(c.withColumn("cmd", cmd))


@query("""WITH RECURSIVE c AS (SELECT user_id % 10 AS lock, event_id + 1 AS idx, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS n, CASE WHEN event_type IN ('signup', 'purchase') THEN 'acquire' WHEN event_type = 'error' THEN 'release' ELSE 'query' END AS op,
  'u' || user_id % 4 AS owner, 5 + event_id % 40 AS entries FROM events),
r AS (SELECT lock, 0::BIGINT AS idx, 0::BIGINT AS n, '' AS reply, NULL::VARCHAR AS held, 0::BIGINT AS expiry FROM c WHERE n = 1
  UNION ALL SELECT c.lock, c.idx, c.n,
    CASE c.op WHEN 'acquire' THEN CASE WHEN r.held IS NULL OR c.idx >= r.expiry THEN 'OK' ELSE 'LOCKED' END WHEN 'release' THEN CASE WHEN r.held = c.owner THEN 'OK' ELSE 'NOT_OWNER' END
      ELSE CASE WHEN r.held IS NULL OR c.idx >= r.expiry THEN 'FREE' ELSE 'LOCKED:' || r.held END END,
    CASE c.op WHEN 'acquire' THEN CASE WHEN r.held IS NULL OR c.idx >= r.expiry THEN c.owner ELSE r.held END WHEN 'release' THEN CASE WHEN r.held = c.owner THEN NULL ELSE r.held END
      ELSE CASE WHEN c.idx >= r.expiry THEN NULL ELSE r.held END END,
    CASE WHEN c.op = 'acquire' AND (r.held IS NULL OR c.idx >= r.expiry) THEN c.idx + c.entries ELSE r.expiry END
  FROM r JOIN c ON c.lock = r.lock AND c.n = r.n + 1)
SELECT lock, idx, reply FROM r WHERE n > 0""")
def lock_replay(v):
    e = v("events")
    op = F.when(F.col("event_type").isin("signup", "purchase"), "acquire").when(F.col("event_type") == "error", "release").otherwise("query")
    return replay.locks(e.select((F.col("user_id") % 10).alias("lock"), (F.col("event_id") + 1).alias("idx"), op.alias("op"), F.concat(F.lit("u"), F.col("user_id") % 4).alias("owner"), (5 + F.col("event_id") % 40).alias("entries")))


#: Serials with a repeat at every fourth request, of these every other one a gap instead; clients divisible by 9 start at 2.
SERIAL = "n - CAST(floor(n / 4.0) AS BIGINT) + CASE WHEN n % 8 = 0 THEN 3 ELSE 0 END + CASE WHEN client_id % 9 = 0 THEN 1 ELSE 0 END"


@query(f"""WITH RECURSIVE s AS (SELECT user_id AS client_id, event_id AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), q AS (SELECT client_id, idx, n, {SERIAL} AS serial_number FROM s),
r AS (SELECT client_id, 0::BIGINT AS idx, 0::BIGINT AS n, 0::BIGINT AS serial_number, '' AS outcome, NULL::BIGINT AS last FROM q WHERE n = 1
  UNION ALL SELECT q.client_id, q.idx, q.n, q.serial_number,
    CASE WHEN r.last IS NULL THEN CASE WHEN q.serial_number = 1 THEN 'applied' ELSE 'rejected' END WHEN q.serial_number <= r.last THEN 'duplicate' WHEN q.serial_number > r.last + 1 THEN 'rejected' ELSE 'applied' END,
    CASE WHEN r.last IS NULL THEN CASE WHEN q.serial_number = 1 THEN 1 END WHEN q.serial_number = r.last + 1 THEN q.serial_number ELSE r.last END
  FROM r JOIN q ON q.client_id = r.client_id AND q.n = r.n + 1)
SELECT client_id, idx, serial_number, outcome FROM r WHERE n > 0""")
def session_dedup(v):
    return replay.sessions(v("session_requests").withColumnRenamed("serial_number", "n").select("client_id", F.col("event_id").alias("idx"), F.expr(SERIAL).cast("long").alias("serial_number")))


@query("SELECT idx, substring(cmd, 8) AS data FROM (SELECT event_id + 1 AS idx, CASE WHEN event_type = 'click' THEN 'APPEND ' || props ELSE 'NOP' END AS cmd FROM events) WHERE cmd LIKE 'APPEND %'")
def append_log(v):
    return replay.appended(v("events").select((F.col("event_id") + 1).alias("idx"), F.when(F.col("event_type") == "click", F.concat(F.lit("APPEND "), "props")).otherwise("NOP").alias("cmd")))


@query("""WITH p AS (SELECT user_id AS op_id, max(event_id) AS idx, max(event_id) + 300 AS deadline FROM events GROUP BY user_id), c AS (SELECT event_id AS commit_index, event_id + event_id % 500 AS t FROM events),
f AS (SELECT op_id, idx, deadline, min(t) AS t FROM p LEFT JOIN c ON idx <= commit_index GROUP BY op_id, idx, deadline)
SELECT op_id, idx, CASE WHEN t <= deadline THEN 'completed' ELSE 'timeout' END AS outcome, CASE WHEN t <= deadline THEN t END AS completed_at FROM f""")
def commit_wait_outcome(v):
    e = v("events")
    p = e.groupBy(F.col("user_id").alias("op_id")).agg(F.max("event_id").alias("idx"), (F.max("event_id") + 300).alias("deadline"))
    c = e.select(F.col("event_id").alias("commit_index"), (F.col("event_id") + F.col("event_id") % 500).alias("at"))
    return replay.commit_waits(p, c)
