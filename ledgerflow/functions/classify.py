"""Ordered rules on texts: errors, timeouts, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell a timeout, and phrases that only speak of settings.
TIMEOUT_WORDS = ("timeout", "timed out", "timed-out", "time out", "time-out", "time_out")
SETTING_PHRASES = ("set timeout", "timeout value", "timeout parameter", "timing out")
#: Class, whether to retry, and the parts of a message that mean it; the first rule that fits counts.
ERROR_RULES = (
    ("network_unreachable", True, ("unreachable", "no route to host")),
    ("connection_refused", True, ("refused",)),
    ("serialization_error", False, ("serialization", "deserialization", "parse", "invalid format", "checksum", "validation failed", "corrupt", "invalid data")),
    ("protocol_error", False, ("protocol", "invalid term", "invalid log index", "invalid candidate", "malformed", "invalid request")),
    ("permanent_failure", False, ("disk full", "out of memory", "memory allocation failure", "no space left", "authentication failed", "permission denied", "access denied", "unauthorized", "forbidden", "node stopped")),
    ("temporary_failure", True, ("temporary", "try again", "busy")),
)
#: Kinds of timeout in order; "connection" must be there beside one of its words.
TIMEOUT_RULES = (
    ("serialization_timeout", "", ("serialization", "encoding", "decoding", "parse")),
    ("connection_failure", "connection", ("dropped", "closed", "reset", "refused", "lost")),
    ("network_delay", "", ("slow", "delay", "partial", "incomplete")),
)


def has_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def error_type(message: Column) -> Column:
    text = F.lower(message)
    out = F.when(has_any(text, TIMEOUT_WORDS) & ~has_any(text, SETTING_PHRASES), "network_timeout")
    for name, _, words in ERROR_RULES:
        out = out.when(has_any(text, words), name)
    return out.otherwise("unknown_error")


def retryable(kind: Column) -> Column:
    return ~kind.isin(*{name for name, retry, _ in ERROR_RULES if not retry})


def timeout_type(message: Column) -> Column:
    text, out = F.lower(message), None
    for name, needs, words in TIMEOUT_RULES:
        test = has_any(text, words) & F.contains(text, F.lit(needs))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("network_timeout")


def backoff_ms(attempt: Column, initial: int, factor: float, most: int) -> Column:
    """Delay before an attempt: the initial one times the factor for each attempt before, whole ms at each step, capped, at least 1."""
    steps = F.when(attempt > 1, F.sequence(F.lit(2), attempt.cast("int"))).otherwise(F.array().cast("array<int>"))
    grown = F.aggregate(steps, F.lit(initial).cast("long"), lambda d, _: F.least(F.floor(d * factor).cast("long"), F.lit(most).cast("long")))
    return F.greatest(F.least(grown, F.lit(most).cast("long")), F.lit(1).cast("long"))


def retransmission_ms(attempt: Column, base: int, factor: float, most: int) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(factor), F.least(attempt, F.lit(20))), F.lit(float(most))).cast("long")


def partitions(errors: DataFrame, key: str) -> DataFrame:
    """Whether a key's errors look like a network partition: three at least, two thirds of them (rounded down) of the network."""
    g = errors.groupBy(key).agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("error_type").isin("network_timeout", "network_unreachable", "connection_refused")).alias("network_errors"))
    return g.withColumn("partitioned", (F.col("errors") >= 3) & (F.col("network_errors") >= F.expr("errors * 2 div 3")))


def retry_policy_valid(initial: Column, most: Column, factor: Column, jitter: Column, attempts: Column) -> Column:
    return (initial > 0) & (most >= initial) & (factor > 1) & jitter.between(0, 1) & (attempts > 0)


def configuration_errors(c) -> Column:
    """Messages of the rules that a configuration row ``c`` (a dict of columns) breaks."""
    rules = (
        (c["election_min"] <= 0, "election timeout must be positive"),
        (c["election_max"] <= c["election_min"], "election timeout range is empty"),
        (c["heartbeat"] <= 0, "heartbeat must be positive"),
        (c["heartbeat"] > F.floor(c["election_min"] / 3), "heartbeat is over a third of the election timeout"),
        (c["max_entries"] == 0, "no entries per append"),
        (c["chunk_size"] > c["snapshot_threshold"], "chunks are larger than a snapshot"),
    )
    return F.filter(F.array(*(F.when(test, text) for test, text in rules)), lambda x: x.isNotNull())


def should_retry(code: Column, attempts: Column, most: int) -> Column:
    """Response codes as class * 100 + detail: 503, 504, 502 and 408 retry up to the limit, 500 only in its first half; others never."""
    return F.when(attempts >= most, False).when(code.isin(503, 504, 502, 408), True).when(code == 500, attempts < most // 2).otherwise(False)


def code_class(code: Column) -> Column:
    #: Response codes that have a meaning.
    client, server = (400, 401, 402, 403, 404, 405, 406, 408, 412, 413, 415), (500, 501, 502, 503, 504, 505)
    return F.when(code.isin(*client), "client_error").when(code.isin(*server), "server_error").otherwise("unknown_error")


def adaptive_timeouts(samples: DataFrame, key: str, window: int = 10, factor: float = 1.2, least: int = 50, most: int = 10000) -> DataFrame:
    """Timeout after each sample: the mean of the last ten times a factor, within limits."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("seq").rowsBetween(1 - window, 0)
    return samples.select(key, "seq", F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.round(F.avg("latency_ms").over(w) * factor, 6)))).cast("long").alias("timeout_ms"))
