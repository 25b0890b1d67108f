"""State machines as folds over ordered commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, order: str, value: str, out: str, block: int = 1 << 20) -> DataFrame:
    """A running sum over a whole log without bringing it to one task: sums within blocks of ``block`` successive indices, plus the sum of all blocks before."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_t"))  # one row a block
    before = totals.select("_block", F.coalesce(F.sum("_t").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocked.join(before, "_block").withColumn(out, F.col("_before") + within).drop("_block", "_before")


def counter(commands: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The counter's value after each command (INC, DEC, RESET, GET).

    Work is by blocks of ``block`` successive indices. Two aggregations without
    a sort give what each block leaves behind: the steps after its last reset,
    or all of its steps. Chained over the blocks, a row each, these are the
    values that the blocks start with; within a block a running sum is enough.
    """
    reset = F.col("cmd") == "RESET"
    c = commands.select("idx", "cmd", F.when(F.col("cmd") == "INC", 1).when(F.col("cmd") == "DEC", -1).otherwise(0).cast("long").alias("_step"), F.floor(F.col("idx") / block).alias("_block"))
    last = c.groupBy("_block").agg(F.max(F.when(reset, F.col("idx"))).alias("_last"))
    left = c.join(last, "_block").groupBy("_block", "_last").agg(F.sum(F.when(F.col("_last").isNull() | (F.col("idx") > F.col("_last")), F.col("_step")).otherwise(0)).alias("_left"))
    # Blocks since the last one with a reset add up.
    order = Window.orderBy("_block")
    runs = left.withColumn("_run", F.count("_last").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.withColumn("_end", F.sum("_left").over(Window.partitionBy("_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
    starts = ends.select("_block", F.coalesce(F.lag("_end").over(order), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    summed = c.withColumn("_sum", F.sum("_step").over(within)).withColumn("_at", F.last(F.when(reset, F.col("_sum")), ignorenulls=True).over(within))
    return summed.join(starts, "_block").select("idx", "cmd", F.when(F.col("_at").isNull(), F.col("_start") + F.col("_sum")).otherwise(F.col("_sum") - F.col("_at")).cast("long").alias("value"))


def kv_final(commands: DataFrame) -> DataFrame:
    """The store after all commands: each key's last put, unless a delete came after. An explicit null value isn't a delete."""
    last = commands.filter("op <> 'get'").groupBy("k").agg(F.max_by(F.struct("op", "v"), "idx").alias("s"))
    return last.filter("s.op = 'put'").select("k", F.col("s.v").alias("v"))


def kv_gets(commands: DataFrame) -> DataFrame:
    """What each get returns: the value of the last put before it; null if there is none or it was deleted."""
    before = Window.partitionBy("k").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op") != "get", F.struct("op", "v")), ignorenulls=True).over(before)
    return commands.withColumn("s", state).filter("op = 'get'").select("idx", "k", F.when(F.col("s.op") == "put", F.col("s.v")).alias("v"))


def _fold(commands: DataFrame, key: str, step, schema: str, columns: list[str]) -> DataFrame:
    """A fold in order of ``idx`` within each key, in Arrow batches sorted by key: ``step(state, row) -> (state, outputs)``."""

    def run(batches):
        import pyarrow as pa

        last, state = object(), None
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            rows = []
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in [key, *columns])):
                if row[0] != last:
                    last, state = row[0], None
                state, out = step(state, row)
                rows.append(out)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])

    return commands.select(key, *columns).repartition(key).sortWithinPartitions(key, "idx").mapInArrow(run, schema)


def register_cas(commands: DataFrame) -> DataFrame:
    """Each register's reply and version: ``WRITE v``, ``READ``, ``CAS a b`` (which succeeds if the value is a and there are just two parts)."""

    def step(state, row):
        reg, idx, cmd = row
        value, version = state or ("", 0)
        if cmd.startswith("WRITE "):
            value, version, reply = cmd[6:], version + 1, "OK"
        elif cmd == "READ":
            reply = value
        elif cmd.startswith("CAS "):
            parts = [p for p in cmd[4:].split(" ") if p]
            ok = len(parts) == 2 and parts[0] == value
            value, version, reply = (parts[1], version + 1, "OK") if ok else (value, version, "FAILED")
        else:
            reply = "UNKNOWN"
        return (value, version), (reg, idx, reply, version)

    return _fold(commands, "register", step, "register long, idx long, reply string, version long", ["idx", "cmd"])


def locks(commands: DataFrame) -> DataFrame:
    """Each lock command's reply. Acquire takes a lock that is free or whose expiry index is reached; release needs the owner and ignores expiry; query evicts an expired lock."""

    def step(state, row):
        lock, idx, op, owner, entries = row
        held, expiry = state or ("", 0)
        if op == "acquire":
            if not held or idx >= expiry:
                return (owner, idx + entries), (lock, idx, "OK")
            return state, (lock, idx, "LOCKED")
        if op == "release":
            return (None, (lock, idx, "OK")) if state and held == owner else (state, (lock, idx, "NOT_OWNER"))
        if not state or idx >= expiry:
            return None, (lock, idx, "FREE")
        return state, (lock, idx, f"LOCKED:{held}")

    return _fold(commands, "lock", step, "lock long, idx long, reply string", ["idx", "op", "owner", "entries"])


def sessions(requests: DataFrame) -> DataFrame:
    """Each request's outcome: a new client must start at serial 1; a serial seen before is a duplicate (served from the cache); a gap is rejected."""

    def step(last, row):
        client, idx, serial = row
        if last is None:
            return (1, (client, idx, serial, "applied")) if serial == 1 else (None, (client, idx, serial, "rejected"))
        if serial <= last:
            return last, (client, idx, serial, "duplicate")
        return (serial, (client, idx, serial, "applied")) if serial == last + 1 else (last, (client, idx, serial, "rejected"))

    return _fold(requests, "client_id", step, "client_id long, idx long, serial_number long, outcome string", ["idx", "serial_number"])


def appended(commands: DataFrame) -> DataFrame:
    """The append log: index and data of each ``APPEND`` command."""
    return commands.filter(F.col("cmd").startswith("APPEND ")).select("idx", F.expr("substring(cmd, 8)").alias("data"))


def applied(entries: DataFrame, bad, policy: str = "halt", batch: int = 100) -> DataFrame:
    """Entries that reach the state machine (normal ones only), with their batch: up to the first bad one (halt), or all but the bad ones (skip).

    The entry's rank is its index less the entries before it that aren't applied, from prefix sums by blocks.
    """
    normal = entries.filter("entry_type = 0").withColumn("_bad", bad)
    if policy == "halt":
        first = normal.filter("_bad").agg(F.min("idx").alias("_first"))
        kept = normal.crossJoin(F.broadcast(first)).filter(F.col("_first").isNull() | (F.col("idx") < F.col("_first"))).drop("_first")
    else:
        kept = normal.filter("NOT _bad")
    ranked = running_sum(kept.withColumn("_one", F.lit(1)), "idx", "_one", "_rank")
    return ranked.select("idx", "term", "command", F.floor((F.col("_rank") - 1) / batch).cast("long").alias("batch"))


def commit_waits(pending: DataFrame, commits: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Outcome of pending operations (``op_id, idx, submitted, deadline``): completed at the first commit (``commit_index, at``) that covers them, if by the deadline, else timeout."""
    both = pending.select("op_id", "idx", "deadline", F.lit(None).cast("long").alias("at")).unionByName(commits.select(F.lit(None).cast("long").alias("op_id"), F.col("commit_index").alias("idx"), F.lit(None).cast("long").alias("deadline"), F.col("at").cast("long").alias("at")))
    both = both.withColumn("_block", F.floor(F.col("idx") / block))
    # The least time at or after an index: within its block, and over all later blocks (a row each).
    later = both.groupBy("_block").agg(F.min("at").alias("_t")).select("_block", F.min("_t").over(Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    own = F.min("at").over(Window.partitionBy("_block").orderBy(F.col("idx").desc()).rangeBetween(Window.unboundedPreceding, 0))
    first = both.withColumn("_own", own).filter("op_id IS NOT NULL").join(later, "_block").withColumn("at", F.least("_own", "_later"))
    return first.select("op_id", "idx", F.when(F.col("at") <= F.col("deadline"), "completed").otherwise("timeout").alias("outcome"), F.when(F.col("at") <= F.col("deadline"), F.col("at")).alias("completed_at"))
