"""Queries on membership, exports, codecs and snapshots."""

from pyspark.sql import functions as F

from ..functions import codecs, text
from ..operators import backup, graph, membership, replay, telemetry
from ..sources import files
from ..sources.tables import VIEWS
from .registry import query


@query("""WITH c AS (SELECT user_id % 5 AS cluster_id, event_id AS idx, list_sort(list_distinct([user_id % 7, user_id % 11, event_id % 5])) AS nodes FROM events WHERE event_id % 3 = 0),
p AS (SELECT *, coalesce(lag(nodes) OVER (PARTITION BY cluster_id ORDER BY idx), []) AS prev FROM c)
SELECT cluster_id, idx, array_to_string(list_filter(nodes, lambda x: NOT list_contains(prev, x)), ',') AS joined, array_to_string(list_filter(prev, lambda x: NOT list_contains(nodes, x)), ',') AS "left" FROM p""")
def membership_changes(v):
    u, e = F.col("user_id"), F.col("event_id")
    return membership.changes(v("events").filter("event_id % 3 = 0").select((u % 5).alias("cluster_id"), e.alias("idx"), F.array_distinct(F.array(u % 7, u % 11, e % 5)).alias("nodes")))


@query("SELECT user_id AS node_id, [user_id % 7, 2, 3] IS NOT NULL AND list_contains([1, 2, 3, 40], user_id) OR (event_id % 2 = 0 AND list_contains([4, 5, 6], user_id)) AS member, event_id FROM events")
def membership_predicate(v):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<bigint>")
    return v("events").select(F.col("user_id").alias("node_id"), membership.is_member(F.col("user_id"), arr(1, 2, 3, 40), arr(4, 5, 6), F.col("event_id") % 2 == 0).alias("member"), "event_id")


@query("SELECT event_id, user_id % 4 > 2 OR (user_id % 4 = 2 AND event_id % 100 >= 50) AS grants FROM events")
def candidate_up_to_date(v):
    return v("events").select("event_id", membership.up_to_date(F.col("user_id") % 4, F.col("event_id") % 100, F.lit(2).cast("long"), F.lit(50).cast("long")).alias("grants"))


@query("""SELECT node_id, seq, coalesce(p, 0) + 1 AS new_term FROM (SELECT user_id AS node_id, event_id AS seq, event_type, lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type = 'error'""")
def candidate_transition(v):
    return membership.candidate_terms(v("events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("term"), F.when(F.col("event_type") == "error", "candidate").otherwise("follower").alias("state")))


@query("SELECT idx, term, entry_type, command FROM log_entries UNION ALL SELECT max(idx) + 1, 999, 2, '' FROM log_entries", "log_entries")
def leader_noop(v):
    return membership.new_leader(v("log_entries"), 999, v("progress"))[0]


@query("SELECT node_id, (SELECT max(idx) FROM log_entries) + 1 AS next_index, 0::BIGINT AS match_index FROM progress", "log_entries", "progress")
def leader_progress(v):
    return membership.new_leader(v("log_entries"), 999, v("progress"))[1]


@query("""SELECT node_id, seq, gap_us FROM (SELECT user_id AS node_id, event_id AS seq, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS gap_us FROM events) WHERE gap_us > 7200000000""")
def election_timeouts(v):
    return membership.timed_out(v("events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")), 7_200_000_000)


@query("SELECT event_id, 150 + CAST('0x' || substr(md5(user_id || ':' || event_id), 1, 8) AS BIGINT) % 151 AS timeout_ms FROM events")
def randomised_timeout(v):
    return v("events").select("event_id", membership.election_timeout(F.col("user_id"), F.col("event_id"), 150, 300).alias("timeout_ms"))


@query("SELECT user_id % 3 AS cluster_id, event_id AS seq, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id % 3 ORDER BY event_id), 0) AS committed FROM events")
def entries_committed(v):
    return membership.committed_delta(v("events").select((F.col("user_id") % 3).alias("cluster_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("commit_index")))


@query("SELECT p.node_id, p.group_id, p.node_id % 4 <> 0 AND p.node_id % 5 <> 1 AS live FROM placement p", "placement")
def liveness_rule(v):
    p = v("placement")
    return membership.liveness(p, p.filter("node_id % 4 <> 0").select("node_id", (F.col("node_id") % 5 != 1).alias("running")))


@query("""SELECT r.node_id, r.idx, r.term FROM replica_logs r JOIN replica_logs s ON s.node_id = r.node_id AND s.idx = 291 AND s.term = 3 WHERE r.idx > 291""", "replica_logs")
def snapshot_install(v):
    s = v("replica_logs").select("node_id").distinct().select("node_id", F.lit(291).cast("long").alias("last_included_index"), F.lit(3).cast("long").alias("last_included_term"))
    return membership.installed(v("replica_logs"), s)


@query("SELECT node_id, match_index FROM progress WHERE node_id % 2 <> 0", "progress")
def pending_peers(v):
    return membership.pending_outside(v("progress").select("node_id", "match_index"), v("progress").filter("node_id % 2 = 0"))


@query("""SELECT k, v FROM (SELECT k, v, op, row_number() OVER (PARTITION BY k ORDER BY idx DESC) AS n FROM kv_commands WHERE op <> 'get') WHERE n = 1 AND op = 'put'""", "kv_commands")
def snapshot_restore(v):
    """The store from a snapshot at index 500 and the commands after it."""
    c = v("kv_commands")
    kept = replay.kv_final(c.filter("idx <= 500")).select(F.lit(500).cast("long").alias("idx"), F.lit("put").alias("op"), "k", "v")
    return replay.kv_final(kept.unionByName(c.filter("idx > 500").select("idx", "op", "k", "v")))


@query("SELECT idx, op, CAST(k AS VARCHAR) AS k, CASE WHEN op = 'put' THEN CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) END AS v FROM kv_commands", "kv_commands")
def kv_codec_round_trip(v):
    c = v("kv_commands").select("idx", "op", F.col("k").cast("string").alias("k"), F.floor("v").cast("string").alias("v"))
    return codecs.decode_commands(codecs.encode_commands(c))


@query("SELECT idx, term, command FROM log_entries", "log_entries")
def json_codec_round_trip(v):
    e = v("log_entries").select(F.struct("term", "idx", F.encode("command", "UTF-8").alias("command"), F.col("entry_type").alias("type")).alias("e"))
    back = e.select(F.from_json(files.entry_to_json(F.col("e")), "term LONG, idx LONG, command STRING, type BYTE").alias("b"))
    return back.select("b.idx", "b.term", F.decode(F.unbase64("b.command"), "UTF-8").alias("command"))


@query("SELECT idx, lpad(CAST(idx AS VARCHAR), 20, '0') AS key, true AS valid FROM log_entries", "log_entries")
def key_padding(v):
    return v("log_entries").select("idx", files.key(F.col("idx")).alias("key")).withColumn("valid", files.is_key(F.col("key")))


@query("""SELECT event_id, '{"timeUnixNano":"' || (epoch_us(ts) * 1000) || '","severityNumber":' || CASE level WHEN 'error' THEN 17 WHEN 'warning' THEN 13 WHEN 'info' THEN 9 ELSE 5 END || ',"severityText":"' ||
  CASE level WHEN 'error' THEN 'ERROR' WHEN 'warning' THEN 'WARN' WHEN 'info' THEN 'INFO' ELSE 'DEBUG' END || '","body":{"stringValue":"' || replace(message, '"', '\\"') || '"}}' AS json FROM log_records""", "log_records")
def otlp_log_records(v):
    return telemetry.otlp_logs(v("log_records"))


@query("""SELECT event_type AS name, CAST(user_id % 3 AS VARCHAR) AS dim_value, '{"name":"' || event_type || '","sum":{"aggregationTemporality":"AGGREGATION_TEMPORALITY_DELTA","isMonotonic":true,"dataPoints":[{"attributes":[{"key":"status","value":{"stringValue":"' || user_id % 3 || '"}}],"asInt":"' || count(*) || '"}]}}' AS json
FROM events GROUP BY event_type, user_id % 3""")
def otlp_metric_sums(v):
    return telemetry.otlp_sums(v("events").groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 3).cast("string").alias("dim_value")).agg(F.count(F.lit(1)).alias("total")))


@query("""SELECT event_id, 'msg="' || replace(message, '"', '\\"') || '" level="' || level || '"' AS line FROM log_records""", "log_records")
def logfmt_lines(v):
    return telemetry.logfmt_lines(v("log_records"))


@query("""SELECT event_id, '{"_time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z","level":"' || level || '","_msg":"' || replace(message, '"', '\\"') || '"}' AS line FROM log_records""", "log_records")
def json_log_lines(v):
    return telemetry.json_lines(v("log_records"))


@query("""SELECT sum(user_id)::BIGINT AS used, round(sum(user_id) / 10000000.0 * 100, 4) AS utilisation_percent, round((1 - sum(ceil(user_id / 64.0)) / 156250.0) * 100, 4) AS free_blocks_percent, count(CASE WHEN 1000 - event_id >= 300 THEN 1 END) AS leaks FROM events WHERE event_type = 'signup'""")
def pool_metrics(v):
    return telemetry.pool(v("events").filter("event_type = 'signup'").select(F.col("user_id").alias("bytes"), F.col("event_id").alias("at")), 10_000_000, 64, 1000, 300)


@query("SELECT user_id AS run, CASE WHEN sum(event_id % 7) = 0 THEN 0.0 ELSE round(count(*) * 1e9 / sum(event_id % 7)::DOUBLE, 4) END AS ops_per_s FROM events GROUP BY user_id")
def operation_rates(v):
    return telemetry.rates(v("events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") % 7).alias("total_ns")))


RELIABILITY = f"""WITH RECURSIVE topology_edges AS ({VIEWS["topology_edges"][1]}), e AS (SELECT DISTINCT src, dst, 1.0::DOUBLE - (src + dst) % 10 / 100.0::DOUBLE AS r FROM topology_edges WHERE src <> dst),
p AS (SELECT src, dst, 1 AS hops, r, [src, dst] AS path FROM e UNION ALL SELECT p.src, e.dst, p.hops + 1, p.r * e.r, list_append(p.path, e.dst) FROM p JOIN e ON p.dst = e.src WHERE NOT list_contains(p.path, e.dst))
SELECT src, dst, round(r, 6) AS reliability FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) AS k FROM p) WHERE k = 1"""


@query(RELIABILITY)
def path_reliability(v):
    """Of the shortest paths of all connected pairs."""
    e = v("topology_edges").filter("src <> dst").withColumn("reliability", 1.0 - (F.col("src") + F.col("dst")) % 10 / 100.0)
    return graph.path_reliability(graph.shortest_paths(e), e).withColumn("reliability", F.round("reliability", 6))


@query(RELIABILITY)
def path_reliability_all(v):
    return path_reliability(v)


@query("SELECT node_id, last_included_index FROM (SELECT user_id AS node_id, event_id AS last_included_index, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3")
def retained_snapshots(v):
    return backup.newest_snapshots(v("events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("last_included_index")), 3)


@query("SELECT key_suffix FROM (SELECT CASE WHEN idx % 17 = 0 THEN substr(key_suffix, 2) ELSE key_suffix END AS key_suffix FROM manifest_objects) WHERE length(key_suffix) <> 20", "manifest_objects")
def backup_bad_keys(v):
    return backup.bad_keys(v("manifest_objects").select(F.when(F.col("idx") % 17 == 0, F.expr("substring(key_suffix, 2)")).otherwise(F.col("key_suffix")).alias("key_suffix")))


@query("SELECT event_id, 'node' || user_id AS host, 7000 + CAST(event_id % 10 AS INTEGER) AS port FROM events")
def host_ports(v):
    a = F.concat(F.lit("node"), F.col("user_id"), F.lit(":"), 7000 + F.col("event_id") % 10)
    return v("events").select("event_id", text.host(a).alias("host"), text.port(a).alias("port"))


@query("SELECT count(*) AS size, count(CASE WHEN k = 7 THEN 1 END) > 0 AS has_7 FROM (SELECT k, op, row_number() OVER (PARTITION BY k ORDER BY idx DESC) AS n FROM kv_commands WHERE op <> 'get') WHERE n = 1 AND op = 'put'", "kv_commands")
def kv_lookups(v):
    return replay.kv_final(v("kv_commands")).agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.bool_or(F.col("k") == 7), F.lit(False)).alias("has_7"))
