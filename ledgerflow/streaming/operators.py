"""Streaming forms of the keyed operators: event time ``ts``, watermark ten minutes, late rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream over a folder of Parquet files, with a time zone on ``ts`` so that it can bear a watermark."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def merged_digests(digests: DataFrame) -> DataFrame:
    """Each node's greatest (term, last index) so far; a mergeable aggregate, so state is one row a node."""
    return digests.groupBy("node_id").agg(F.max(F.struct("term", "last_log_index")).alias("d")).select("node_id", "d.term", "d.last_log_index")


def windowed_metrics(samples: DataFrame, value: str, width: str = "1 hour") -> DataFrame:
    """Count and sum of each series in tumbling windows."""
    w = samples.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width).alias("w"), "name")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("w.start").alias("start"), "name", "n", "total")


def first_sightings(messages: DataFrame, expiry: str = "5 minutes") -> DataFrame:
    """Messages without repeats of an id within the expiry."""
    return messages.withWatermark("ts", expiry).dropDuplicatesWithinWatermark(["msg_id"])


def idle_sessions(activity: DataFrame, gap: str = "1 hour") -> DataFrame:
    s = activity.withWatermark("ts", WATERMARK).groupBy("conn", F.session_window("ts", gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("events")).select("conn", F.col("w.start").alias("start"), "events")


def _folded(commands: DataFrame, key: str, step, columns: list[str], out: str, state: str) -> DataFrame:
    """A fold in order of ``idx`` within each key and batch, its state kept between batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [f.split()[0] for f in out.split(", ")]

    def run(k, frames, kept):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("idx")
        now, made = tuple(kept.get) if kept.exists else None, []
        for row in rows[[key, *columns]].itertuples(index=False):
            now, reply = step(now, tuple(row))
            made.append(reply)
        if now is None:
            if kept.exists:
                kept.remove()
        else:
            kept.update(now)
        yield pd.DataFrame(made, columns=names)

    return commands.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def sessions(requests: DataFrame) -> DataFrame:
    """Outcomes of session requests: applied, duplicate or rejected, as in the batch form."""

    def step(state, row):
        client, idx, serial = row
        last = state[0] if state else 0
        if serial == last + 1:
            return (int(serial),), (client, idx, serial, "applied")
        return state, (client, idx, serial, "duplicate" if serial <= last else "rejected")

    return _folded(requests, "client_id", step, ["idx", "serial_number"], "client_id long, idx long, serial_number long, outcome string", "last long")


def locks(commands: DataFrame) -> DataFrame:
    """Replies of lock commands, as in the batch form."""

    def step(state, row):
        lock, idx, op, owner, entries = row
        if op == "acquire":
            if not state or idx >= state[1]:
                return (owner, int(idx + entries)), (lock, idx, "OK")
            return state, (lock, idx, "LOCKED")
        if op == "release":
            return (None, (lock, idx, "OK")) if state and state[0] == owner else (state, (lock, idx, "NOT_OWNER"))
        if not state or idx >= state[1]:
            return None, (lock, idx, "FREE")
        return state, (lock, idx, f"LOCKED:{state[0]}")

    return _folded(commands, "lock", step, ["idx", "op", "owner", "entries"], "lock long, idx long, reply string", "owner string, expiry long")


def exported(samples: DataFrame, write, batch: int = 512):
    """A query that hands each micro-batch's lines to ``write(frame, batch id)``, numbered in groups of ``batch`` a task."""

    def each(frame: DataFrame, n: int) -> None:
        part = F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / batch)
        write(frame.withColumn("batch", F.struct(F.spark_partition_id().alias("task"), part.alias("n"))), n)

    return samples.writeStream.foreachBatch(each)
