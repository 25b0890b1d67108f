"""Whole jobs against plain loops."""

import math
import random
from collections import deque

import pytest
from compare import differs

from ledgerflow import plans
from ledgerflow.operators import backup, graph, log, membership, replay, telemetry
from ledgerflow.sources.tables import load


def plain_hops(edges):
    out = {}
    for s in {a for a, _ in edges}:
        far, todo = {s: 0}, deque([s])
        while todo:
            at = todo.popleft()
            for a, b in edges:
                if a == at and b not in far:
                    far[b] = far[at] + 1
                    todo.append(b)
        out |= {(s, d): h for d, h in far.items() if d != s}
    return out


def test_paths_have_no_hop_limit(spark, small):
    edges = {(r.src, r.dst) for r in load(spark, small, "topology_edges").collect()}
    want = plain_hops(edges)
    got = {(r.src, r.dst): r.hops for r in plans.queries()["shortest_hops_all"](spark, small).collect()}
    assert got == want and max(want.values()) > 6
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(9)], "src int, dst int, latency_ms int")
    assert graph.shortest_paths(chain).count() == 45


@pytest.mark.parametrize("name", ["shortest_hops_all", "path_latency_all", "route_outcome_all"])
def test_all_paths_match_their_sql(spark, small, name):
    assert not differs(spark, small, plans.queries()[name], plans.oracle_sql()[name])


def test_reliability_of_all_connected_pairs(spark, small):
    want = plain_hops({(r.src, r.dst) for r in load(spark, small, "topology_edges").collect()})
    got = {(r.src, r.dst) for r in plans.queries()["path_reliability_all"](spark, small).collect()}
    assert got == set(want)
    assert not differs(spark, small, plans.queries()["path_reliability_all"], plans.oracle_sql()["path_reliability_all"])


def test_commit_waits_by_small_blocks(spark):
    import random

    rng = random.Random(4)
    pending = [(i, rng.randrange(60), rng.randrange(120)) for i in range(80)]
    commits = [(rng.randrange(50), rng.randrange(100)) for _ in range(40)]
    p, c = spark.createDataFrame(pending, "op_id long, idx long, deadline long"), spark.createDataFrame(commits, "commit_index long, at long")
    want = {i: min([t for k, t in commits if k >= idx], default=None) for i, idx, _ in pending}
    for block in (1, 7, 1000):
        got = {r.op_id: (r.outcome, r.completed_at) for r in replay.commit_waits(p, c, block).collect()}
        assert got == {i: ("completed", want[i]) if want[i] is not None and want[i] <= d else ("timeout", None) for i, _, d in pending}


def test_fetch_range_by_small_blocks(spark):
    entries = spark.createDataFrame([(i, i // 5) for i in range(1, 40) if i != 23], "idx long, term long")
    asked = spark.createDataFrame([(1, 1, 10), (2, 20, 30), (3, 23, 25), (4, 38, 60), (5, 9, 8)], "req_id long, from_index long, to_index long")
    for block in (3, 1024):
        got = {r.req_id: (r.n_entries, r.last_served) for r in log.fetch_range(asked, entries, block).collect()}
        assert got == {1: (10, 10), 2: (3, 22), 3: (0, None), 4: (2, 39), 5: (0, None)}


def test_a_later_revocation_counts(spark):
    events = spark.createDataFrame([(1, 7, "revoke"), (2, 7, "issue"), (3, 7, "revoke"), (4, 7, "revoke"), (5, 8, "issue"), (6, 9, "revoke")], "idx long, serial long, kind string")
    assert {r.serial: (r.issued_at, r.revoked_at) for r in backup.ledger(events).collect()} == {7: (2, 4), 8: (5, None)}
    assert {(r.serial, r.idx) for r in backup.unknown_revocations(events).collect()} == {(7, 1), (9, 6)}


def most_rows_shuffled(spark, run):
    """``run()``, and the most rows that a stage of it read from a shuffle."""
    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleReadRecords() for i in range(found.size())}

    earlier = set(stages())
    out = run()
    return out, max(n for i, n in stages().items() if i not in earlier)


@pytest.mark.parametrize("bins", [2, 7, 500])
@pytest.mark.parametrize("place", ["below", "at"])
def test_percentiles_of_odd_values(spark, monkeypatch, place, bins):
    monkeypatch.setattr(telemetry, "BINS", bins)
    rng, shares = random.Random(5), (0.0, 0.25, 0.5, 0.95, 0.999, 1.0)
    groups = {"one": [3.5], "ties": [7.0] * 900 + [rng.random() for _ in range(100)], "nulls": [None] * 9 + [2.0, 1.0], "only nulls": [None, None], None: [float(i) for i in range(50)],
              "ends": [-math.inf] * 3 + [math.inf] * 3 + [0.0, -1.0], "nan": [math.nan, 1.0, math.nan, None], "wide": [rng.choice((1, -1)) * 10 ** rng.uniform(-300, 300) for _ in range(400)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    samples = spark.createDataFrame(rows, "name string, x double")
    got = {r[0]: tuple(map(repr, r[1:])) for r in telemetry.percentiles(samples, "name", "x", shares, place).collect()}

    def at(vs, q):
        vs = sorted(vs, key=lambda v: (v is None, v is not None and math.isnan(v), 0.0 if v is None or math.isnan(v) else v))
        return vs[math.floor(q * (len(vs) - 1)) if place == "below" else min(math.floor(q * len(vs)), len(vs) - 1)]

    assert got == {k: tuple(repr(at(vs, q)) for q in shares) for k, vs in groups.items()}
    assert telemetry.percentiles(samples.filter("false"), "name", "x", shares, place).count() == 0
    whole = telemetry.percentiles(samples.filter("x between -1000 and 1000").selectExpr("name", "cast(x as decimal(10, 2)) as x"), "name", "x", (0.5,), place)
    assert whole.columns == ["name", "p50"] and whole.schema["p50"].dataType.simpleString() == "decimal(10,2)"


def test_percentiles_sort_no_group_whole(spark):
    n = 100_000
    samples = spark.range(n).selectExpr("'a' as name", "cast((id * 7919) % 100003 as double) as x")
    rows, most = most_rows_shuffled(spark, lambda: telemetry.percentiles(samples, "name", "x", (0.5, 0.99)).collect())
    values = sorted(i * 7919 % 100003 for i in range(n))
    assert [tuple(r) for r in rows] == [("a", values[(n - 1) // 2], values[math.floor(0.99 * (n - 1))])]
    assert most < n // 20  # all of them before


def test_snapshots_are_installed_by_blocks(spark):
    rng = random.Random(3)
    entries = [(n, i, i // 7) for n in (1, 2, 3, None) for i in range(-4, 60) if rng.random() < 0.9] + [(1, 30, 4), (1, 31, 4), (2, None, 1), (4, 5, None)]
    taken = [(1, 20, 2), (1, 30, 4), (2, 10, 9), (3, -2, -1), (3, -2, -1), (None, 8, 1), (4, 5, None), (5, 1, 0)]
    log_, snapshots = spark.createDataFrame(entries, "node_id long, idx long, term long"), spark.createDataFrame(taken, "node_id long, last_included_index long, last_included_term long")
    want = sorted((n, i, t) for s, last, term in taken for held in entries for n, i, t in entries if None not in (s, term, i) and held == (s, last, term) and n == s and i > last)
    for block in (1, 7, 1 << 16):
        assert sorted(tuple(r) for r in membership.installed(log_, snapshots, block).collect()) == want


def test_a_long_log_takes_a_snapshot_without_a_shuffle(spark):
    n = 200_000
    entries = spark.range(n).selectExpr("id % 2 as node_id", "id as idx", "id div 100 as term")
    snapshots = spark.range(2).selectExpr("id as node_id", "290 + id as last_included_index", "2 + 7 * id as last_included_term")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")  # over the size of snapshots and blocks, not of the log
    try:
        count, most = most_rows_shuffled(spark, lambda: membership.installed(entries, snapshots).groupBy("node_id").count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [tuple(r) for r in count] == [(0, n // 2 - 146)]
    assert most < n // 20  # all of them before
