"""Log, vote, metric and other tables as views over the event, order and part tables, in one SQL dialect that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

#: For each view the tables it reads and its text.
VIEWS = {
    "log_entries": ("events", """SELECT event_id + 1 AS idx, 1 + CAST(floor(event_id / 100.0) AS BIGINT) AS term,
        CASE WHEN event_id % 100 = 0 THEN 2 WHEN event_id % 250 = 7 THEN 1 ELSE 0 END AS entry_type, event_type AS command FROM events"""),
    "kv_commands": ("events", """SELECT event_id + 1 AS idx, CASE WHEN event_type IN ('signup', 'purchase') THEN 'put' WHEN event_type = 'error' THEN 'del' ELSE 'get' END AS op,
        user_id % 50 AS k, value AS v FROM events"""),
    "counter_commands": ("events", """SELECT event_id + 1 AS idx, CASE WHEN event_type IN ('signup', 'purchase') THEN 'INC' WHEN event_type = 'click' THEN 'DEC'
        WHEN event_type = 'view' THEN 'GET' ELSE 'RESET' END AS cmd FROM events"""),
    "progress": ("events", "SELECT user_id % 3 AS cluster_id, user_id AS node_id, max(event_id) + 1 AS match_index FROM events GROUP BY user_id"),
    "replica_logs": ("events", """SELECT r.node_id, l.idx, CASE WHEN r.node_id = 2 AND l.idx % 97 = 0 THEN l.term + 1 ELSE l.term END AS term, l.command
        FROM (SELECT event_id + 1 AS idx, 1 + CAST(floor(event_id / 100.0) AS BIGINT) AS term, event_type AS command FROM events) l
        CROSS JOIN (SELECT 0 AS node_id UNION ALL SELECT 1 UNION ALL SELECT 2) r"""),
    "vote_responses": ("orders", "SELECT o_orderkey % 50 AS term, o_custkey % 5 AS candidate_id, o_custkey AS voter_id, o_orderstatus <> 'F' AS vote_granted FROM orders"),
    "topology_edges": ("nation", """SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, 1 + (n_nationkey * 13) % 40 AS latency_ms FROM nation
        UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25, 1 + (n_nationkey * 11) % 40 FROM nation"""),
    "metric_samples": ("lineitem", """SELECT l_returnflag AS name, l_linestatus AS dim_value, l_extendedprice / 10.0 AS duration_ms, l_quantity AS gauge_value,
        l_orderkey AS ord, l_linenumber AS ord2 FROM lineitem"""),
    "placement": ("supplier nation", "SELECT s.s_suppkey AS node_id, n.n_name AS group_id, s.s_acctbal >= 0 AS live FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey"),
    "targets": ("nation", "SELECT n_name AS group_id, 1 + n_nationkey % 4 AS target_count, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 END AS learner_capacity FROM nation"),
    "gossip_digests": ("events", "SELECT user_id AS node_id, 1 + CAST(floor(event_id / 100.0) AS BIGINT) AS term, event_id AS last_log_index, ts FROM events"),
    "error_messages": ("documents", "SELECT doc_id, lower(text) AS msg FROM documents"),
    "manifest_objects": ("documents", "SELECT doc_id AS idx, lpad(CAST(doc_id AS STRING), 20, '0') AS key_suffix, length(text) AS size_chars, md5(text) AS checksum_md5 FROM documents"),
    "log_records": ("events", """SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'info' ELSE 'debug' END AS level,
        props AS message FROM events"""),
    "session_requests": ("events", "SELECT event_id, user_id AS client_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS serial_number FROM events"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's DataFrame over the tables of ``sf_dir``; a table's own name gives the table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, text = VIEWS[name]
    return spark.sql(_bound(text, reads.split()), **{t: load(spark, sf_dir, t) for t in reads.split()})


def _bound(text: str, tables: list[str]) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", text)


def with_views(sql: str, *names: str) -> str:
    """``sql`` after common table expressions for the views ``names``."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names) + (", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else " " + sql)
