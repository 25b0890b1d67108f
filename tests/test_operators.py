import __spark_entry__ as entry
import pytest
from compare import differs
from pyspark.sql import functions as F

from ledgerflow import plans
from ledgerflow.functions import classify, codecs, text
from ledgerflow.operators import log, quorum, replay, telemetry
from ledgerflow.sources import files

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, small, name):
    assert not differs(spark, small, plans.queries()[name], SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 1000


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_counter_by_small_blocks(spark):
    cmds = ["INC", "INC", "RESET", "DEC", "GET", "INC", "INC", "RESET", "INC", "GET"] * 3
    df = spark.createDataFrame(list(enumerate(cmds)), "idx long, cmd string")
    want, value = [], 0
    for c in cmds:
        value = {"INC": value + 1, "DEC": value - 1, "RESET": 0, "GET": value}[c]
        want.append(value)
    for block in (1, 3, 7, 1000):
        assert [r.value for r in replay.counter(df, block).orderBy("idx").collect()] == want


def test_register(spark):
    cmds = ["READ", "WRITE a", "CAS a b", "CAS a c", "CAS b", "READ", "WRITE x y", "READ"]
    got = replay.register_cas(spark.createDataFrame([(1, i, c) for i, c in enumerate(cmds)], "register long, idx long, cmd string")).orderBy("idx").collect()
    assert [(r.reply, r.version) for r in got] == [("", 0), ("OK", 1), ("OK", 2), ("FAILED", 2), ("FAILED", 2), ("b", 2), ("OK", 3), ("x y", 3)]


def test_locks(spark):
    rows = [(1, 1, "acquire", "a", 10), (1, 2, "acquire", "b", 10), (1, 3, "release", "b", 0), (1, 4, "query", "", 0), (1, 11, "acquire", "b", 5), (1, 16, "query", "", 0), (1, 17, "release", "b", 0)]
    got = replay.locks(spark.createDataFrame(rows, "lock long, idx long, op string, owner string, entries long")).orderBy("idx").collect()
    assert [r.reply for r in got] == ["OK", "LOCKED", "NOT_OWNER", "LOCKED:a", "OK", "FREE", "NOT_OWNER"]


def test_sessions(spark):
    rows = [(1, i, s) for i, s in enumerate([2, 1, 1, 2, 4, 3])]
    got = replay.sessions(spark.createDataFrame(rows, "client_id long, idx long, serial_number long")).orderBy("idx").collect()
    assert [r.outcome for r in got] == ["rejected", "applied", "duplicate", "applied", "rejected", "applied"]


def test_packed_lines(spark):
    lines = [("e", i, "x" * n) for i, n in enumerate([5, 4, 10, 1, 30, 2])]
    got = telemetry.packed_lines(spark.createDataFrame(lines, "exporter string, seq long, line string"), 10).orderBy("seq").collect()
    assert [r.payload for r in got] == [0, 0, 1, 2, 3, 4]


def test_codecs(spark):
    rows = [(1, "put", "k", "väl"), (2, "get", "k", None), (3, "del", "ключ", None)]
    df = spark.createDataFrame(rows, "idx long, op string, k string, v string")
    encoded = codecs.encode_commands(df)
    assert {r.idx: bytes(r.command) for r in encoded.collect()} == {i: codecs.encode_command(o, k, v) for i, o, k, v in rows}
    assert sorted(tuple(r) for r in codecs.decode_commands(encoded).collect()) == rows
    bad = spark.createDataFrame([(1, b""), (2, b"\x09\0\0\0\0\0\0\0\0"), (3, None)], "idx long, command binary")
    assert all(r.op is None for r in codecs.decode_commands(bad).collect())
    state = b"\2" + b"\0" * 7 + b"".join(len(x).to_bytes(4, "little") + x for x in (b"a", b"1", b"b", b""))
    got = codecs.decode_snapshots(spark.createDataFrame([(7, bytearray(state)), (8, bytearray(8)), (9, None)], "snapshot_id long, state binary"))
    assert sorted(tuple(r) for r in got.collect()) == [(7, "a", "1"), (7, "b", "")]


def test_json_log(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, b"\0\xff", 0), (1, 2, b"", 2)], "term long, idx long, command binary, type byte")
    files.write_json_log(df, str(tmp_path / "l"))
    assert sorted(map(repr, files.read_json_log(spark, str(tmp_path / "l")).collect())) == sorted(map(repr, df.collect()))
    (tmp_path / "o" / "log").mkdir(parents=True)
    for key, idx in (("0" * 19 + "1", 1), ("0" * 19 + "2", 3)):
        (tmp_path / "o" / "log" / key).write_text(f'{{"term": 1, "idx": {idx}, "command": "", "type": 0}}')
    (tmp_path / "o" / "meta").write_text("{}")
    got = {r.key: (r.kind, r.mismatch) for r in files.read_objects(spark, str(tmp_path / "o")).collect()}
    assert got == {"0" * 19 + "1": ("entry", False), "0" * 19 + "2": ("entry", True), "meta": ("metadata", False)}


def test_text_functions(spark):
    assert one(spark, telemetry.sanitize_name(F.lit("9a-b:c"))) == "_9a_b:c" and one(spark, telemetry.sanitize_name(F.lit(""), False)) == "_"
    assert one(spark, telemetry.escape_label(F.lit('a\\b"\n'))) == 'a\\\\b\\"\\n'
    assert one(spark, text.percent_encode(F.lit("a b*~é/"))) == "a%20b%2A~%C3%A9%2F"
    assert one(spark, text.frame_length(F.lit(bytearray(b"\0\0\1\0rest")))) == 256 and one(spark, text.frame_length(F.lit(bytearray(b"\xff\xff\xff\xff")))) is None
    assert one(spark, text.host(F.lit("h:80"))) == "h" and one(spark, text.port(F.lit("h:80"))) == 80
    assert one(spark, text.message_type(F.lit('{"type": "vote"}'))) == "vote"
    assert one(spark, classify.retransmission_ms(F.lit(3), 2000, 2.0, 60000)) == 16000
    assert one(spark, telemetry.one_hot(F.lit(7.0), (1, 10))) == [0, 1, 0] and one(spark, telemetry.one_hot(F.lit(70.0), (1, 10))) == [0, 0, 1]
    assert one(spark, quorum.status(F.lit(0), F.lit(0))) == "healthy" and one(spark, quorum.status(F.lit(5), F.lit(3))) == "critical"
    broken = {k: F.lit(v) for k, v in dict(election_min=150, election_max=100, heartbeat=60, max_entries=0, chunk_size=1, snapshot_threshold=2).items()}
    assert len(one(spark, classify.configuration_errors(broken))) == 3


def test_empty_snapshot_has_a_last_chunk(spark):
    df = spark.createDataFrame([(1, 0), (2, 25), (3, 20)], "id long, n long")
    got = sorted((r.id, r.offset, r.length, r.done) for r in log.chunks(df, F.col("n"), 10).collect())
    assert got == [(1, 0, 0, True), (2, 0, 10, False), (2, 10, 10, False), (2, 20, 5, True), (3, 0, 10, False), (3, 10, 10, True)]
