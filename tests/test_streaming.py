import shutil

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import backup, replay
from ledgerflow.streaming import operators as streaming


@pytest.fixture()
def stream(spark, small, tmp_path):
    """The events in three files by time, read one file a batch."""
    events = spark.read.parquet(f"{small}/events.parquet")
    for i in range(3):
        events.filter(f"event_id >= {i * 334} AND event_id < {(i + 1) * 334}").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        part = next((tmp_path / f"p{i}").glob("part-*"))
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(part, tmp_path / "in" / f"{i}.parquet")
    return streaming.read_events(spark, str(tmp_path / "in"), events.schema, 1), events.withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(repr, spark.table(name).collect()))


def test_digests(spark, stream, tmp_path):
    def digests(e):
        return e.select(F.col("user_id").alias("node_id"), (1 + F.floor(F.col("event_id") / 100)).alias("term"), F.col("event_id").alias("last_log_index"))

    s, b = stream
    assert run(spark, streaming.merged_digests(digests(s)), "complete", "digests", tmp_path) == sorted(map(repr, backup.merged_digests(digests(b)).collect()))


def test_sessions(spark, stream, tmp_path):
    def requests(e):
        return e.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("idx"), (F.col("event_id") % 7 + 1).alias("serial_number"))

    s, b = stream
    assert run(spark, streaming.sessions(requests(s)), "append", "sessions", tmp_path) == sorted(map(repr, replay.sessions(requests(b)).collect()))


def test_locks(spark, stream, tmp_path):
    def commands(e):
        op = F.when(F.col("event_type").isin("signup", "purchase"), "acquire").when(F.col("event_type") == "error", "release").otherwise("query")
        return e.select((F.col("user_id") % 5).alias("lock"), F.col("event_id").alias("idx"), op.alias("op"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("owner"), (5 + F.col("event_id") % 40).alias("entries"))

    s, b = stream
    assert run(spark, streaming.locks(commands(s)), "append", "locks", tmp_path) == sorted(map(repr, replay.locks(commands(b)).collect()))


def test_windows(spark, stream, tmp_path):
    s, b = stream
    named = lambda e: e.withColumn("name", F.col("event_type"))
    got = run(spark, streaming.windowed_metrics(named(s), "value", "1 day"), "append", "windows", tmp_path)
    want = set(map(repr, streaming.windowed_metrics(named(b), "value", "1 day").collect()))
    assert got and set(got) <= want  # windows that the watermark hasn't passed stay open
