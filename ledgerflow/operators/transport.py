"""Data rules of message transports: blocks, duplicates, responses, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_size(wanted: Column) -> Column:
    """The largest power of two of 16 to 1024 that isn't above the size wanted."""
    out = F.lit(16)
    for n in (32, 64, 128, 256, 512, 1024):
        out = F.when(wanted >= n, n).otherwise(out)
    return out


def split_blocks(payloads: DataFrame, size: Column, wanted: int) -> DataFrame:
    """Blocks of each payload (``msg_id``); the last may be short, an empty payload has none."""
    bs = block_size(F.lit(wanted))
    e = payloads.select("msg_id", size.cast("long").alias("_n"), bs.alias("_b")).filter("_n > 0")
    e = e.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("_b")))))
    return e.select("msg_id", "block", F.least(F.col("_b").cast("long"), F.col("_n") - F.col("block") * F.col("_b")).alias("length"), ((F.col("block") + 1) * F.col("_b") < F.col("_n")).alias("more"))


def check_blocks(blocks: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Per token whether its blocks (``token, arrival, block, length, size, more``) come in order, full but for the last, and within the limit."""
    w = Window.partitionBy("token").orderBy("arrival")
    c = blocks.withColumn("_k", F.row_number().over(w) - 1)
    ok = (F.col("block") == F.col("_k")) & F.when(F.col("more"), (F.col("length") == F.col("size")) & (F.col("length") > 0)).otherwise(F.col("length") <= F.col("size"))
    return c.groupBy("token").agg((F.bool_and(ok) & (F.sum("length") <= limit)).alias("complete"), F.sum("length").cast("long").alias("bytes"), F.count(F.lit(1)).alias("blocks"))


def duplicates(messages: DataFrame, expiry_us: int = 300_000_000) -> DataFrame:
    """Messages (``msg_id, seq, at_us``) that repeat one seen within five minutes of its first sighting; the window starts anew after that.

    In order within each id, in Arrow batches sorted by it.
    """

    def run(batches):
        import pyarrow as pa

        last, first = object(), 0
        for b in batches:
            out = []
            for m, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                dup = m == last and t - first <= expiry_us
                if not dup:
                    last, first = m, t
                out.append(dup)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["msg_id", "seq", "duplicate"])

    return messages.select("msg_id", "seq", "at_us").repartition("msg_id").sortWithinPartitions("msg_id", "at_us", "seq").mapInArrow(run, "msg_id long, seq long, duplicate boolean")


def collected_responses(requests: DataFrame, responses: DataFrame, timeout_us: int) -> DataFrame:
    """Responses to each multicast (by token) up to its timeout: how many, and the responders in order."""
    j = requests.join(responses, "token", "left").withColumn("_in", F.col("at_us").between(F.col("sent_us"), F.col("sent_us") + timeout_us))
    return j.groupBy("token").agg(F.count_if("_in").alias("responses"), F.count_distinct(F.when(F.col("_in"), F.col("responder"))).alias("responders"))


def evicted(entries: DataFrame, capacity: int) -> DataFrame:
    """Entries that a cache over its capacity drops: the least used, of these the oldest."""
    w = Window.partitionBy("cache").orderBy("access_count", "created", "entry_id")
    c = entries.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cache")))
    return c.filter(F.col("_k") <= F.col("_n") - capacity).select("cache", "entry_id")


def in_flight(events: DataFrame, limit: int) -> DataFrame:
    """Requests in flight after each start (+1) and end (-1) of an endpoint, and whether they are within the limit."""
    w = Window.partitionBy("endpoint").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("in_flight", F.sum("delta").over(w).cast("long")).select("endpoint", "seq", "in_flight", (F.col("in_flight") <= limit).alias("allowed"))


def partition_flags(failures: DataFrame, limit_us: int = 120_000_000) -> DataFrame:
    """Failures that come over two minutes after the endpoint's last recorded one."""
    gap = F.col("at_us") - F.lag("at_us").over(Window.partitionBy("endpoint").orderBy("at_us", "seq"))
    return failures.select("endpoint", "seq", F.coalesce(gap > limit_us, F.lit(False)).alias("partitioned"))


def replay_window(messages: DataFrame, width: int = 64) -> DataFrame:
    """Messages (``sender, seq, number``) that are refused: ``width`` or more behind the highest before, or accepted once already."""
    before = Window.partitionBy("sender").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    again = F.row_number().over(Window.partitionBy("sender", "number").orderBy("seq")) > 1
    old = F.coalesce(F.max("number").over(before) - F.col("number") >= width, F.lit(False))
    return messages.select("sender", "seq", "number", (old | again).alias("refused"))


def correlated(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each response with the pending request of its token; null for none."""
    return responses.join(requests.select("token", "request_id"), "token", "left")
