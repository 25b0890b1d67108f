"""Queries on metrics, records, messages, networks and backups."""

from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import backup, graph, telemetry, transport
from .registry import query

BOUNDS = telemetry.BOUNDS
LE = "CASE " + " ".join(f"WHEN duration_ms <= {b} THEN {b}.0::DOUBLE" for b in BOUNDS) + " END"
CLASS = "CASE WHEN ({}) AND NOT ({}) THEN 'network_timeout' {} ELSE 'unknown_error' END".format(
    " OR ".join(f"contains(msg, '{w}')" for w in classify.TIMEOUT_WORDS), " OR ".join(f"contains(msg, '{w}')" for w in classify.SETTING_PHRASES),
    " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"contains(msg, '{w}')" for w in words), name) for name, _, words in classify.ERROR_RULES))
TIMEOUT = "CASE {} ELSE 'network_timeout' END".format(" ".join("WHEN contains(msg, '{}') AND ({}) THEN '{}'".format(need, " OR ".join(f"contains(msg, '{w}')" for w in words), name) for name, need, words in classify.TIMEOUT_RULES))
NO_RETRY = ", ".join(f"'{n}'" for n, r, _ in classify.ERROR_RULES if not r)


@query("SELECT name, dim_value, round(sum(gauge_value), 2) AS total FROM metric_samples GROUP BY name, dim_value", "metric_samples")
def counter_metric(v):
    return telemetry.counters(v("metric_samples"), "gauge_value").withColumn("total", F.round("total", 2))


@query("SELECT name, dim_value, gauge_value AS value FROM (SELECT *, row_number() OVER (PARTITION BY name, dim_value ORDER BY ord DESC, ord2 DESC, gauge_value DESC) AS n FROM metric_samples) WHERE n = 1", "metric_samples")
def gauge_last(v):
    return telemetry.gauges(v("metric_samples"), "gauge_value", "ord", "ord2", "gauge_value")


@query(f"SELECT name, dim_value, {LE} AS le, count(*) AS n FROM metric_samples GROUP BY ALL", "metric_samples")
def histogram_buckets(v):
    return telemetry.histogram(v("metric_samples"), "duration_ms")


@query("SELECT name, dim_value, le, n FROM (" + " UNION ALL ".join([*(f"SELECT name, dim_value, '{b}' AS le, count(CASE WHEN duration_ms <= {b} THEN 1 END) AS n FROM metric_samples GROUP BY ALL" for b in BOUNDS), "SELECT name, dim_value, '+Inf' AS le, count(*) AS n FROM metric_samples GROUP BY ALL"]) + ")", "metric_samples")
def histogram_cumulative(v):
    return telemetry.cumulative(v("metric_samples"), "duration_ms")


def _places(expr):
    return f"""SELECT name, max(CASE WHEN i = {expr.format(q=0.5)} THEN duration_ms END) AS p50, max(CASE WHEN i = {expr.format(q=0.95)} THEN duration_ms END) AS p95, max(CASE WHEN i = {expr.format(q=0.99)} THEN duration_ms END) AS p99
FROM (SELECT name, duration_ms, row_number() OVER (PARTITION BY name ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM metric_samples) GROUP BY name"""


@query(_places("floor({q}::DOUBLE * (n - 1))"), "metric_samples")
def percentiles_p1(v):
    return telemetry.percentiles(v("metric_samples"), "name", "duration_ms", (0.5, 0.95, 0.99))


@query(_places("least(floor({q}::DOUBLE * n), n - 1)"), "metric_samples")
def percentiles_p2(v):
    return telemetry.percentiles(v("metric_samples"), "name", "duration_ms", (0.5, 0.95, 0.99), "at")


@query("""SELECT name, count(*) AS n, min(duration_ms) AS least, max(duration_ms) AS most, round(avg(duration_ms), 4) AS mean, round(stddev_pop(duration_ms), 4) AS stddev,
  round(round(stddev_pop(duration_ms), 4) / greatest(round(avg(duration_ms), 4), 1e-9) * 100, 2) AS variation_percent FROM metric_samples GROUP BY name""", "metric_samples")
def latency_stats(v):
    return telemetry.latency_stats(v("metric_samples"), "name", "duration_ms")


def _event_counts(v):
    return v("events").groupBy(F.concat(F.lit("9ev-"), "event_type").alias("name"), F.concat(F.lit('a"b\\'), F.col("user_id") % 3).alias("dim_value")).agg(F.count(F.lit(1)).alias("total"))


PROM = r"""l AS (SELECT '_9ev_' || event_type || '_total' AS metric, '_9ev_' || event_type || '_total{status="a\"b\\' || user_id % 3 || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 3)"""


@query(f"WITH {PROM} SELECT metric, line FROM l")
def prometheus_lines(v):
    return telemetry.prometheus_lines(_event_counts(v))


@query(f"WITH {PROM} SELECT metric, '# TYPE ' || metric || ' counter' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS text FROM l GROUP BY metric")
def prometheus_text(v):
    return telemetry.exposition(telemetry.prometheus_lines(_event_counts(v)))


@query(r"""SELECT event_id, event_type || '\ x,user=u\=' || user_id || ' count=' || user_id % 7 || 'i ' || (event_id * 1000) AS line FROM events""")
def influx_lines(v):
    line = telemetry.influx_line(F.concat("event_type", F.lit(" x")), [("user", F.concat(F.lit("u="), F.col("user_id")))], F.col("user_id") % 7, F.col("event_id") * 1000)
    return v("events").select("event_id", line.alias("line"))


@query("SELECT event_id, event_type || ':' || user_id % 7 || '|c|#user:' || user_id AS line FROM events")
def statsd_lines(v):
    return v("events").select("event_id", telemetry.statsd_line(F.col("event_type"), F.col("user_id") % 7, "counter", [("user", F.col("user_id").cast("string"))]).alias("line"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(level) || ': ' || message AS line FROM log_records", "log_records")
def console_lines(v):
    return telemetry.console_lines(v("log_records"))


@query("""SELECT level, count(*) AS entries, min_by(message, event_id) AS first_message, max_by(message, event_id) AS last_message FROM log_records GROUP BY level""", "log_records")
def loki_streams(v):
    return telemetry.loki_streams(v("log_records"))


@query("SELECT event_id, level FROM log_records WHERE level IN ('warning', 'error')", "log_records")
def min_level_records(v):
    return telemetry.min_level(v("log_records"), "warning").select("event_id", "level")


@query("SELECT event_id, event_type || chr(31) || 'a' || chr(31) || user_id % 3 || chr(31) || 'b' || chr(31) || 'x' AS key FROM events")
def series_keys(v):
    labels = F.array(F.struct(F.lit("b").alias("k"), F.lit("x").alias("v")), F.struct(F.lit("a").alias("k"), (F.col("user_id") % 3).cast("string").alias("v")))
    return v("events").select("event_id", telemetry.series_key(F.col("event_type"), labels).alias("key"))


@query()
def pack_lines(v):
    return telemetry.packed_lines(v("events").select("event_type", F.col("event_id").alias("seq"), F.repeat("props", (F.col("user_id") % 40 + 1).cast("int")).alias("line")).withColumnRenamed("event_type", "exporter"))


MESSAGES = "m AS (SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(("RPC timeout", "set timeout to 5", "No route to host", "Connection refused", "cannot parse", "checksum differs", "malformed PDU", "no space left", "node stopped", "resource busy", "request timed out: connection reset", "slow link, time out"))) + " END AS message FROM events), n AS (SELECT event_id, lower(message) AS msg FROM m)"


def _messages(v):
    texts = ("RPC timeout", "set timeout to 5", "No route to host", "Connection refused", "cannot parse", "checksum differs", "malformed PDU", "no space left", "node stopped", "resource busy", "request timed out: connection reset", "slow link, time out")
    return v("events").select("event_id", "user_id", F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 12 + 1).cast("int")).alias("message"))


@query(f"WITH {MESSAGES}, c AS (SELECT event_id, {CLASS} AS error_type FROM n) SELECT event_id, error_type, error_type NOT IN ({NO_RETRY}) AS should_retry FROM c")
def classify_errors(v):
    kind = classify.error_type(F.col("message"))
    return _messages(v).select("event_id", kind.alias("error_type")).withColumn("should_retry", classify.retryable(F.col("error_type")))


@query(f"SELECT doc_id, {CLASS} AS error_type FROM error_messages", "error_messages")
def classify_documents(v):
    return v("error_messages").select("doc_id", classify.error_type(F.col("msg")).alias("error_type"))


@query(f"WITH {MESSAGES} SELECT event_id, {TIMEOUT} AS timeout_type FROM n")
def classify_timeouts(v):
    return _messages(v).select("event_id", classify.timeout_type(F.col("message")).alias("timeout_type"))


@query("SELECT CAST(a AS INTEGER) AS attempt, CAST(least(100 * pow(2, a - 1), 5000) AS BIGINT) AS delay_ms FROM (SELECT unnest(generate_series(1, 12)) AS a)")
def backoff_schedule(v):
    return v("region").limit(1).select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("attempt")).withColumn("delay_ms", classify.backoff_ms(F.col("attempt"), 100, 2.0, 5000))


@query(f"""WITH {MESSAGES}, c AS (SELECT n.event_id, e.user_id, {CLASS} AS error_type FROM n JOIN events e USING (event_id))
SELECT user_id, count(*) AS errors, count(CASE WHEN error_type IN ('network_timeout', 'network_unreachable', 'connection_refused') THEN 1 END) AS network_errors,
  count(*) >= 3 AND count(CASE WHEN error_type IN ('network_timeout', 'network_unreachable', 'connection_refused') THEN 1 END) >= floor(count(*) * 2 / 3.0) AS partitioned FROM c GROUP BY user_id""")
def partition_heuristic(v):
    return classify.partitions(_messages(v).withColumn("error_type", classify.error_type(F.col("message"))), "user_id")


HEADERS = ("text/html; q=0.8, application/json", " application/cbor ,, */*", "image/*, text/*;q=1", "video/mp4", "")


def _headers(v):
    return v("events").select("event_id", F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("event_id") % len(HEADERS) + 1).cast("int")).alias("header"))


HEADER_SQL = "h AS (SELECT event_id, CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(HEADERS)) + " END AS header FROM events), a AS (SELECT event_id, list_filter(list_transform(string_split(header, ','), lambda x: trim(split_part(x, ';', 1))), lambda x: x <> '') AS types FROM h)"


@query(f"WITH {HEADER_SQL} SELECT event_id, array_to_string(types, '|') AS accepted FROM a")
def accept_parse(v):
    return _headers(v).select("event_id", F.array_join(text.accepted(F.col("header")), "|").alias("accepted"))


@query(f"""WITH {HEADER_SQL}, s AS (SELECT 1 AS j, 'application/json' AS m UNION ALL SELECT 2, 'application/cbor' UNION ALL SELECT 3, 'text/plain'), u AS (SELECT event_id, unnest(types) AS t, generate_subscripts(types, 1) AS i FROM a),
c AS (SELECT event_id, m, row_number() OVER (PARTITION BY event_id ORDER BY i, j) AS k FROM u JOIN s ON t = '*/*' OR t = m OR (t LIKE '%/*' AND starts_with(m, replace(t, '*', ''))))
SELECT h.event_id, c.m AS media_type FROM h LEFT JOIN c ON c.event_id = h.event_id AND k = 1""")
def negotiate_media_type(v):
    return _headers(v).select("event_id", text.negotiate(F.col("header"), ["application/json", "application/cbor", "text/plain"]).alias("media_type"))


@query("SELECT CAST(log2(n) - 4 AS INTEGER) AS szx, CAST(n AS INTEGER) AS size, true AS valid FROM (SELECT 16 * pow(2, unnest(generate_series(0, 6))) AS n)")
def szx_table(v):
    n = v("region").limit(1).select(F.explode(F.sequence(F.lit(16), F.lit(1024))).alias("size")).filter(text.block_size_valid(F.col("size")))
    return n.select(text.szx(F.col("size")).alias("szx"), text.szx_size(text.szx(F.col("size"))).alias("size"), text.block_size_valid(F.col("size")).alias("valid"))


@query("""WITH p AS (SELECT idx AS msg_id, size_chars AS n FROM manifest_objects WHERE size_chars > 0), b AS (SELECT msg_id, n, unnest(generate_series(0, CAST(floor((n - 1) / 512.0) AS BIGINT))) AS block FROM p)
SELECT msg_id, block, least(512, n - block * 512) AS length, (block + 1) * 512 < n AS more FROM b""", "manifest_objects")
def block_split(v):
    return transport.split_blocks(v("manifest_objects").withColumnRenamed("idx", "msg_id"), F.col("size_chars"), 700)


@query("""WITH p AS (SELECT idx AS token, size_chars AS n FROM manifest_objects WHERE size_chars > 0), b AS (SELECT token, n, unnest(generate_series(0, CAST(floor((n - 1) / 512.0) AS BIGINT))) AS block FROM p)
SELECT token, NOT (token % 5 = 0 AND count(*) > 1) AS complete, sum(least(512, n - block * 512))::BIGINT AS bytes, count(*) AS blocks FROM b GROUP BY token""", "manifest_objects")
def block_reassembly_check(v):
    b = transport.split_blocks(v("manifest_objects").withColumnRenamed("idx", "msg_id"), F.col("size_chars"), 512)
    swapped = F.when(F.col("msg_id") % 5 == 0, -F.col("block")).otherwise(F.col("block"))
    return transport.check_blocks(b.select(F.col("msg_id").alias("token"), swapped.alias("arrival"), "block", "length", F.lit(512).alias("size"), "more"))


@query("""SELECT o_custkey % 50 AS token, count(CASE WHEN o_orderkey BETWEEN 100 AND 700 THEN 1 END) AS responses, count(DISTINCT CASE WHEN o_orderkey BETWEEN 100 AND 700 THEN o_custkey END) AS responders FROM orders GROUP BY 1""")
def multicast_collect(v):
    o = v("orders").select((F.col("o_custkey") % 50).alias("token"), F.col("o_custkey").alias("responder"), F.col("o_orderkey").alias("at_us"))
    return transport.collected_responses(o.select("token").distinct().withColumn("sent_us", F.lit(100)), o, 600)


@query("""WITH c AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 503 WHEN 1 THEN 500 WHEN 2 THEN 404 WHEN 3 THEN 408 WHEN 4 THEN 502 WHEN 5 THEN 501 WHEN 6 THEN 999 ELSE 504 END AS code, user_id % 6 AS attempts FROM events)
SELECT event_id, code, CASE WHEN code = 999 THEN 'unknown_error' WHEN code >= 500 THEN 'server_error' ELSE 'client_error' END AS error_class, CASE WHEN attempts >= 4 THEN false WHEN code IN (503, 504, 502, 408) THEN true WHEN code = 500 THEN attempts < 2 ELSE false END AS retry FROM c""")
def retry_decision(v):
    code = F.element_at(F.array(*map(F.lit, (503, 500, 404, 408, 502, 501, 999, 504))), (F.col("event_id") % 8 + 1).cast("int"))
    return v("events").select("event_id", code.alias("code"), classify.code_class(code).alias("error_class"), classify.should_retry(code, F.col("user_id") % 6, 4).alias("retry"))


@query("""SELECT cache, entry_id FROM (SELECT user_id % 5 AS cache, user_id AS entry_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY count(*), min(event_id), user_id) AS k, count(*) OVER (PARTITION BY user_id % 5) AS n FROM events GROUP BY user_id) WHERE k <= n - 20""")
def cache_evict(v):
    e = v("events").groupBy(F.col("user_id").alias("entry_id"), (F.col("user_id") % 5).alias("cache")).agg(F.count(F.lit(1)).alias("access_count"), F.min("event_id").alias("created"))
    return transport.evicted(e, 20)


@query("""SELECT user_id, address, len(string_split(address, '.')) = 4 AND coalesce(TRY_CAST(split_part(address, '.', 1) AS INTEGER) BETWEEN 224 AND 239, false) AS multicast
FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 9 = 0 THEN 'x.1.2.3' WHEN user_id % 7 = 0 THEN '224.1.2' ELSE (200 + user_id % 50) || '.999.x.1' END AS address FROM events)""")
def multicast_address_check(v):
    u = F.col("user_id")
    a = F.when(u % 9 == 0, "x.1.2.3").when(u % 7 == 0, "224.1.2").otherwise(F.concat(200 + u % 50, F.lit(".999.x.1")))
    return v("events").select("user_id", a.alias("address")).distinct().withColumn("multicast", text.multicast_address(F.col("address")))


@query("""WITH t AS (SELECT 'TLSv1.2' AS x UNION ALL SELECT 'TLSv1.3' UNION ALL SELECT '' UNION ALL SELECT 'TLSv1.1'), o AS (SELECT x, CASE x WHEN 'TLSv1.2' THEN 2 WHEN 'TLSv1.3' THEN 3 WHEN '' THEN 0 ELSE -1 END AS n FROM t)
SELECT a.x AS low, b.x AS high, a.n >= 0 AND b.n >= 0 AND CASE WHEN a.n = 0 THEN 2 ELSE a.n END <= CASE WHEN b.n = 0 THEN 3 ELSE b.n END AS valid FROM o a CROSS JOIN o b""")
def tls_range_check(v):
    versions = F.array(*map(F.lit, ("TLSv1.2", "TLSv1.3", "", "TLSv1.1")))
    pairs = v("region").limit(1).select(F.explode(versions).alias("low")).withColumn("high", F.explode(versions))
    return pairs.withColumn("valid", text.tls_range_valid(F.col("low"), F.col("high")))


@query("""SELECT o_orderkey, CASE WHEN TIMESTAMP '1998-01-01' < o_orderdate THEN 'not_yet_valid' WHEN TIMESTAMP '1998-01-01' > o_orderdate + INTERVAL 400 DAY THEN 'expired' WHEN o_orderdate + INTERVAL 400 DAY <= TIMESTAMP '1998-01-31' THEN 'expires_soon' ELSE 'valid' END AS state FROM orders""")
def cert_validity(v):
    after = F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")
    return v("orders").select("o_orderkey", text.certificate_state(F.col("o_orderdate"), after, F.lit("1998-01-01").cast("timestamp_ntz")).alias("state"))


@query("""SELECT event_id, replace(replace(replace(replace(replace(replace(replace(props, '%', '%25'), '{', '%7B'), '}', '%7D'), '"', '%22'), ':', '%3A'), ' ', '%20'), ',', '%2C') AS encoded FROM events""")
def percent_encode(v):
    return v("events").select("event_id", text.percent_encode(F.col("props")).alias("encoded"))


@query("""WITH e AS (SELECT user_id % 10 AS endpoint, event_id AS seq, CASE WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type IN ('view', 'click') THEN -1 ELSE 0 END AS delta FROM events),
s AS (SELECT endpoint, seq, sum(delta) OVER (PARTITION BY endpoint ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS in_flight FROM e) SELECT *, in_flight <= 5 AS allowed FROM s""")
def inflight_limit(v):
    d = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type").isin("view", "click"), -1).otherwise(0)
    return transport.in_flight(v("events").select((F.col("user_id") % 10).alias("endpoint"), F.col("event_id").alias("seq"), d.alias("delta")), 5)


@query("""SELECT user_id AS endpoint, event_id AS seq, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) > 120000000, false) AS partitioned FROM events WHERE event_type = 'error'""")
def endpoint_partition(v):
    return transport.partition_flags(v("events").filter("event_type = 'error'").select(F.col("user_id").alias("endpoint"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")))


@query("""SELECT user_id AS sender, event_id AS seq, event_id * 7 % 501 AS number, coalesce(max(event_id * 7 % 501) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - event_id * 7 % 501 >= 64, false)
  OR row_number() OVER (PARTITION BY user_id, event_id * 7 % 501 ORDER BY event_id) > 1 AS refused FROM events""")
def replay_window(v):
    return transport.replay_window(v("events").select(F.col("user_id").alias("sender"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 501).alias("number")))


@query("""WITH RECURSIVE m AS (SELECT user_id AS msg_id, event_id AS seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT msg_id, seq, n, false AS duplicate, t AS first FROM m WHERE n = 1
  UNION ALL SELECT m.msg_id, m.seq, m.n, m.t - r.first <= 300000000, CASE WHEN m.t - r.first <= 300000000 THEN r.first ELSE m.t END FROM r JOIN m ON m.msg_id = r.msg_id AND m.n = r.n + 1)
SELECT msg_id, seq, duplicate FROM r""")
def message_dedup(v):
    return transport.duplicates(v("events").select(F.col("user_id").alias("msg_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")))


@query("""SELECT key, seq, CAST(greatest(50, least(10000, floor(round(avg(l) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * 1.2, 6)))) AS BIGINT) AS timeout_ms FROM (SELECT user_id AS key, event_id AS seq, event_id * 37 % 20000 AS l FROM events)""")
def adaptive_timeout(v):
    return classify.adaptive_timeouts(v("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 20000).alias("latency_ms")), "key")


EDGES = "e AS (SELECT src, dst, min(latency_ms) AS l FROM topology_edges WHERE src <> dst GROUP BY src, dst)"


PATHS = f"""WITH RECURSIVE {{views}}, {EDGES}, p AS (SELECT src, dst, 1 AS hops, l::BIGINT AS latency_ms, [src, dst] AS path FROM e
  UNION ALL SELECT p.src, e.dst, p.hops + 1, p.latency_ms + e.l, list_append(p.path, e.dst) FROM p JOIN e ON p.dst = e.src WHERE NOT list_contains(p.path, e.dst)),
b AS (SELECT src, dst, hops, latency_ms, path FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) AS k FROM p) WHERE k = 1)"""


def _paths_sql(tail):
    from ..sources.tables import VIEWS

    return PATHS.format(views=f"topology_edges AS ({VIEWS['topology_edges'][1]})") + tail


@query(_paths_sql(" SELECT src, dst, hops FROM b"))
def shortest_hops(v):
    return graph.shortest_paths(v("topology_edges")).select("src", "dst", "hops")


@query(_paths_sql(" SELECT src, dst, latency_ms, array_to_string(path, '>') AS path FROM b"))
def path_latency(v):
    return graph.shortest_paths(v("topology_edges")).select("src", "dst", "latency_ms", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(_paths_sql(""", m AS (SELECT event_id AS msg_id, CAST(user_id % 27 AS INTEGER) AS src, CAST(event_id % 26 AS INTEGER) AS dst FROM events)
SELECT msg_id, CASE WHEN m.src > 24 OR m.dst > 24 THEN 'unknown_node' WHEN m.src <> m.dst AND b.hops IS NULL THEN 'no_path' ELSE 'delivered' END AS outcome,
  CASE WHEN m.src > 24 OR m.dst > 24 THEN NULL WHEN m.src = m.dst THEN 0 ELSE b.latency_ms END AS latency_ms FROM m LEFT JOIN b ON b.src = m.src AND b.dst = m.dst"""))
def route_outcome(v):
    m = v("events").select(F.col("event_id").alias("msg_id"), (F.col("user_id") % 27).cast("int").alias("src"), (F.col("event_id") % 26).cast("int").alias("dst"))
    return graph.route_outcomes(m, graph.shortest_paths(v("topology_edges")), v("nation").select(F.col("n_nationkey").alias("node")))


@query(_paths_sql(" SELECT src, dst, hops FROM b"))
def shortest_hops_all(v):
    return graph.shortest_paths(v("topology_edges")).select("src", "dst", "hops")


@query(_paths_sql(" SELECT src, dst, latency_ms, array_to_string(path, '>') AS path FROM b"))
def path_latency_all(v):
    return graph.shortest_paths(v("topology_edges")).select("src", "dst", "latency_ms", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(_paths_sql(""", m AS (SELECT event_id AS msg_id, CAST(user_id % 27 AS INTEGER) AS src, CAST(event_id % 26 AS INTEGER) AS dst FROM events)
SELECT msg_id, CASE WHEN m.src > 24 OR m.dst > 24 THEN 'unknown_node' WHEN m.src <> m.dst AND b.hops IS NULL THEN 'no_path' ELSE 'delivered' END AS outcome,
  CASE WHEN m.src > 24 OR m.dst > 24 THEN NULL WHEN m.src = m.dst THEN 0 ELSE b.latency_ms END AS latency_ms FROM m LEFT JOIN b ON b.src = m.src AND b.dst = m.dst"""))
def route_outcome_all(v):
    m = v("events").select(F.col("event_id").alias("msg_id"), (F.col("user_id") % 27).cast("int").alias("src"), (F.col("event_id") % 26).cast("int").alias("dst"))
    return graph.route_outcomes(m, graph.shortest_paths(v("topology_edges")), v("nation").select(F.col("n_nationkey").alias("node")))


@query("""WITH u AS (SELECT DISTINCT user_id % 7 AS node, 49152 + event_id % 300 AS port FROM events WHERE event_id % 97 <> 5), r AS (SELECT node, port - row_number() OVER (PARTITION BY node ORDER BY port) AS d, port FROM u)
SELECT n.node, coalesce(max(CASE WHEN d = 49151 THEN port END) + 1, 49152)::BIGINT AS port FROM (SELECT DISTINCT node FROM u) n LEFT JOIN r USING (node) GROUP BY n.node""")
def ephemeral_port(v):
    return graph.ephemeral_port(v("events").filter("event_id % 97 <> 5").select((F.col("user_id") % 7).alias("node"), (49152 + F.col("event_id") % 300).alias("port")))


@query("""SELECT endpoint, conn_id, k AS place FROM (SELECT user_id % 10 AS endpoint, user_id AS conn_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY max(event_id) DESC, user_id) AS k FROM events GROUP BY user_id) WHERE k <= 4""")
def pool_lru(v):
    return graph.pool_kept(v("events").groupBy(F.col("user_id").alias("conn_id"), (F.col("user_id") % 10).alias("endpoint")).agg(F.max("event_id").alias("last_used")), 4)


@query("""WITH g AS (SELECT user_id, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, event_id, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id AS conn, session, count(*) AS events, min(event_id) AS first_seq FROM s GROUP BY user_id, session""")
def idle_sessions(v):
    return graph.idle_sessions(v("events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), "ts"), 3600)


@query("SELECT user_id AS conn, sum(length(props))::BIGINT AS bytes, count(*) AS messages, max(event_id) AS last_seq FROM events GROUP BY user_id")
def connection_totals(v):
    return graph.connection_totals(v("events").select(F.col("user_id").alias("conn"), F.length("props").alias("bytes"), F.col("event_id").alias("seq")))


@query("SELECT event_id AS msg_id, user_id AS dst, event_id AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events")
def message_queue(v):
    return graph.queues(v("events").select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("dst"), F.col("event_id").alias("arrival")))


@query("SELECT src, dst, latency_ms FROM topology_edges WHERE src % 5 <> 0 AND dst % 5 <> 0", "topology_edges")
def remove_nodes(v):
    return graph.without_node(v("topology_edges"), v("nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("node")))


@query("SELECT key_suffix FROM manifest_objects WHERE idx % 10 = 0", "manifest_objects")
def backup_missing(v):
    return backup.missing(v("manifest_objects"), v("manifest_objects").filter("idx % 10 <> 0"))


@query("""SELECT key_suffix, CASE WHEN idx % 10 = 0 THEN 'missing' WHEN idx % 11 = 0 THEN 'size_mismatch' ELSE 'checksum_mismatch' END AS problem FROM manifest_objects WHERE idx % 10 = 0 OR idx % 11 = 0 OR idx % 13 = 0""", "manifest_objects")
def backup_checksum(v):
    m = v("manifest_objects")
    stored = m.filter("idx % 10 <> 0").withColumns({"size_chars": F.when(F.col("idx") % 11 == 0, -1).otherwise(F.col("size_chars")), "checksum_md5": F.when(F.col("idx") % 13 == 0, "x").otherwise(F.col("checksum_md5"))})
    return backup.object_problems(m, stored)


@query("WITH l AS (SELECT idx FROM log_entries WHERE idx > 10 AND idx % 150 <> 0) SELECT idx FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.idx + 1 = a.idx) AND idx <> 11", "log_entries")
def log_contiguity(v):
    return backup.gaps(v("log_entries").filter("idx > 10 AND idx % 150 <> 0"), 10)


@query("SELECT idx, term FROM log_entries WHERE term > 7", "log_entries")
def term_regression(v):
    return backup.term_regressions(v("log_entries"), 7)


@query("""SELECT CASE WHEN idx % 10 = 0 THEN 'missing' WHEN idx % 11 = 0 THEN 'size_mismatch' ELSE 'checksum_mismatch' END AS problem, key_suffix AS at FROM manifest_objects WHERE idx % 10 = 0 OR idx % 11 = 0 OR idx % 13 = 0
UNION ALL SELECT 'gap', CAST(idx + 1 AS VARCHAR) FROM log_entries WHERE idx > 10 AND idx % 150 = 0 AND idx + 1 <= (SELECT max(idx) FROM log_entries)
UNION ALL SELECT 'term_regression', CAST(idx AS VARCHAR) FROM log_entries WHERE idx > 10 AND idx % 150 <> 0 AND (idx % 77 = 5 OR term > 7)""", "manifest_objects", "log_entries")
def backup_verify(v):
    m = v("manifest_objects")
    stored = m.filter("idx % 10 <> 0").withColumns({"size_chars": F.when(F.col("idx") % 11 == 0, -1).otherwise(F.col("size_chars")), "checksum_md5": F.when(F.col("idx") % 13 == 0, "x").otherwise(F.col("checksum_md5"))})
    log = v("log_entries").filter("idx > 10 AND idx % 150 <> 0").withColumn("term", F.when(F.col("idx") % 77 != 5, F.col("term")))
    return backup.verified(m, stored, log, 10, 7)


@query("SELECT entry_type AS \"group\", min(idx) AS first_index, max(idx) AS last_index, count(*) AS entries, CAST(sum(strlen(command)) AS BIGINT) AS bytes, max_by(term, idx) AS last_term FROM log_entries GROUP BY entry_type", "log_entries")
def backup_create(v):
    return backup.created(v("log_entries").withColumnRenamed("entry_type", "group"), "group")


@query("SELECT max(user_id) + 1 AS next_serial FROM events WHERE event_type = 'signup'")
def next_serial(v):
    return backup.next_serials(_ledger_events(v))


LEDGER = "e AS (SELECT event_id AS idx, user_id AS serial, CASE WHEN event_type = 'signup' THEN 'issue' WHEN event_type = 'error' THEN 'revoke' END AS kind FROM events), i AS (SELECT serial, min(idx) AS issued_at FROM e WHERE kind = 'issue' GROUP BY serial), l AS (SELECT serial, issued_at, (SELECT max(idx) FROM e WHERE e.kind = 'revoke' AND e.serial = i.serial AND e.idx > i.issued_at) AS revoked_at FROM i)"


def _ledger_events(v):
    return v("events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("serial"), F.when(F.col("event_type") == "signup", "issue").when(F.col("event_type") == "error", "revoke").alias("kind"))


@query(f"WITH {LEDGER} SELECT * FROM l")
def ledger_state(v):
    return backup.ledger(_ledger_events(v))


@query(f"WITH {LEDGER} SELECT serial, revoked_at FROM l WHERE revoked_at IS NOT NULL")
def crl(v):
    return backup.crl(backup.ledger(_ledger_events(v)))


@query(f"WITH {LEDGER} SELECT serial, idx FROM e WHERE kind = 'revoke' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.kind = 'issue' AND b.serial = e.serial AND b.idx < e.idx)")
def unknown_revocations(v):
    return backup.unknown_revocations(_ledger_events(v))


@query("SELECT node_id, max(term) AS term, max(last_log_index) AS last_log_index FROM gossip_digests GROUP BY node_id", "gossip_digests")
def gossip_merge(v):
    return backup.merged_digests(v("gossip_digests"))


@query("""WITH d AS (SELECT node_id, max(term) AS term, max(last_log_index) AS last_log_index, max(ts) AS ts FROM gossip_digests GROUP BY node_id), n AS (SELECT max(ts) AS now FROM gossip_digests) SELECT node_id, term, last_log_index FROM d CROSS JOIN n WHERE ts + INTERVAL 1 DAY >= now""", "gossip_digests")
def gossip_prune(v):
    d = v("gossip_digests").groupBy("node_id").agg(F.max("term").alias("term"), F.max("last_log_index").alias("last_log_index"), F.max("ts").alias("ts"))
    now = F.broadcast(v("gossip_digests").agg(F.max("ts").alias("now")))
    return d.crossJoin(now).filter(F.col("ts") + F.expr("INTERVAL 1 DAY") >= F.col("now")).select("node_id", "term", "last_log_index")


@query("""WITH d AS (SELECT node_id, max(last_log_index) AS x FROM gossip_digests GROUP BY node_id) SELECT min(node_id) AS node_id, count(*) AS sources FROM d WHERE node_id % 2 = 0 AND node_id <> 4 AND x >= 500""", "gossip_digests")
def catch_up_source(v):
    m = v("events").select(F.col("user_id").alias("node_id")).distinct().filter("node_id % 2 = 0")
    return backup.catch_up_sources(backup.merged_digests(v("gossip_digests")), m, 4, 500)
