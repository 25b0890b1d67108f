"""Metrics and log records: aggregation, percentiles, text formats."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Default upper bounds of histogram buckets in ms (fixed values).
BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
#: Bins of values that percentiles are looked for in; one holds about two of so many parts of the rows at most, equal values aside.
BINS = 500


def counters(samples: DataFrame, value: str = "value") -> DataFrame:
    return samples.groupBy("name", "dim_value").agg(F.sum(value).alias("total"))


def gauges(samples: DataFrame, value: str, *order: str) -> DataFrame:
    """The last value of each series."""
    return samples.groupBy("name", "dim_value").agg(F.max_by(value, F.struct(*order)).alias("value"))


def bucket(x: Column, bounds=BOUNDS) -> Column:
    """The first bound that isn't below ``x``; null above all."""
    out = F.lit(None).cast("double")
    for b in reversed(bounds):
        out = F.when(x <= b, float(b)).otherwise(out)
    return out


def histogram(samples: DataFrame, value: str, bounds=BOUNDS) -> DataFrame:
    """Count of each series' values per bucket; null is the overflow bucket."""
    return samples.groupBy("name", "dim_value", bucket(F.col(value), bounds).alias("le")).agg(F.count(F.lit(1)).alias("n"))


def cumulative(samples: DataFrame, value: str, bounds=BOUNDS) -> DataFrame:
    """Every bucket of each series with the count of values up to its bound, in one pass: one conditional count a bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    g = samples.groupBy("name", "dim_value").agg(*counts, F.count(F.lit(1)).alias("_inf"))
    cells = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n")))
    return g.select("name", "dim_value", F.explode(cells).alias("c")).select("name", "dim_value", "c.le", "c.n")


def one_hot(x: Column, bounds=BOUNDS) -> Column:
    """A delta histogram of one value: counts per bucket, overflow last."""
    le = bucket(x, bounds)
    return F.array(*(F.when(le == b, 1).otherwise(0) for b in bounds), F.when(le.isNull() & x.isNotNull(), 1).otherwise(0))


def percentiles(samples: DataFrame, key: str, value: str, shares: tuple[float, ...], place: str = "below") -> DataFrame:
    """Values at a place of the sorted list, never between two: place floor(q * (n - 1)) ("below") or least(floor(q * n), n - 1) ("at"). Values are numbers; nulls come last.

    No group is sorted whole. Values fall into ``BINS`` bins, parted at quantiles
    of all samples (how near these are matters for the bins' sizes only), and
    counts by key and bin say which bin holds each place. Only rows of those
    bins are ranked, equal values as one.
    """
    from pyspark.ml.feature import Bucketizer

    x = F.col(value).cast("double")
    found = samples.select(x.alias("_x")).approxQuantile("_x", [i / BINS for i in range(1, BINS)], 0.5 / BINS)
    splits = [-math.inf, *sorted({q + 0.0 for q in found if math.isfinite(q)} or {0.0}), math.inf]
    rows = samples.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.coalesce(x, F.lit(0.0)).alias("_x"))
    binned = Bucketizer(splits=splits, inputCol="_x", outputCol="_at", handleInvalid="keep").transform(rows)
    binned = binned.select("_k", "_v", F.when(F.col("_v").isNull(), len(splits)).otherwise(F.col("_at").cast("int")).alias("_b"))

    bins = Window.partitionBy("_k")
    counted = binned.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_c"))  # a key has BINS + 2 rows at most
    before = F.coalesce(F.sum("_c").over(bins.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select("_k", "_b", "_c", before.alias("_before"), F.sum("_c").over(bins).alias("_n"))
    at = [F.floor(q * (F.col("_n") - 1)) if place == "below" else F.least(F.floor(q * F.col("_n")), F.col("_n") - 1) for q in shares]

    def holds(p: Column, first: Column) -> Column:
        return (first <= p) & (p < first + F.col("_c"))

    wanted = counted.filter(reduce(Column.__or__, (holds(p, F.col("_before")) for p in at))).select(F.col("_k").alias("_key"), F.col("_b").alias("_bin"), "_before", "_n")
    wanted = materialize(wanted, "places")  # of known size, so that few keys are broadcast and many aren't
    kept = binned.join(wanted, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bin")))
    values = kept.groupBy("_k", "_b", "_before", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    earlier = F.sum("_c").over(Window.partitionBy("_k", "_b").orderBy(F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    ranked = values.withColumn("_first", F.col("_before") + F.coalesce(earlier, F.lit(0)))
    names = [f"p{str(q * 100).rstrip('0').rstrip('.').replace('.', '_')}" for q in shares]
    return ranked.groupBy(F.col("_k").alias(key)).agg(*(F.max(F.when(holds(p, F.col("_first")), F.col("_v"))).alias(name) for name, p in zip(names, at)))


def latency_stats(samples: DataFrame, key: str, value: str) -> DataFrame:
    g = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("stddev"))
    return g.withColumn("variation_percent", F.round(F.col("stddev") / F.greatest(F.col("mean"), F.lit(1e-9)) * 100, 2))


def sanitize_name(name: Column, colons: bool = True) -> Column:
    """Metric names allow letters, digits, _ and :, label names no colon; other characters become _, and a digit in front gets one."""
    s = F.regexp_replace(name, "[^a-zA-Z0-9_:]" if colons else "[^a-zA-Z0-9_]", "_")
    return F.when((s == "") | s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def escape_label(value: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def prometheus_lines(totals: DataFrame, label: str = "status") -> DataFrame:
    """Counter samples as lines of the text exposition."""
    name = F.concat(sanitize_name(F.col("name")), F.lit("_total"))
    return totals.select(name.alias("metric"), F.concat(name, F.lit(f'{{{label}="'), escape_label(F.col("dim_value")), F.lit('"} '), F.col("total").cast("long").cast("string")).alias("line"))


def exposition(lines: DataFrame) -> DataFrame:
    """One text per metric: its type, then its lines in order (a line a series)."""
    body = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    return lines.groupBy("metric").agg(F.concat(F.lit("# TYPE "), F.first("metric"), F.lit(" counter\n"), body).alias("text"))


def influx_escape(text: Column, tag: bool = False) -> Column:
    for c in ",", " ", *("=",) * tag:
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return F.replace(text, F.lit("\n"), F.lit("_"))


def influx_line(name: Column, tags: list[tuple[str, Column]], count: Column, ts_ns: Column) -> Column:
    parts = [influx_escape(name), *(F.concat(F.lit(f",{k}="), influx_escape(v, True)) for k, v in tags)]
    return F.concat(*parts, F.lit(" count="), count.cast("string"), F.lit("i "), ts_ns.cast("string"))


def statsd_line(name: Column, value: Column, kind: str, tags: list[tuple[str, Column]]) -> Column:
    line = F.concat(name, F.lit(":"), value.cast("string"), F.lit(f"|{ {'counter': 'c', 'duration': 'ms', 'gauge': 'g'}[kind]}"))
    return F.concat(line, F.lit("|#"), F.concat_ws(",", *(F.concat(F.lit(f"{k}:"), v) for k, v in tags))) if tags else line


def series_key(name: Column, labels: Column) -> Column:
    """Name and labels in order, joined by a unit separator."""
    return F.concat_ws("\x1f", name, F.transform(F.array_sort(labels), lambda x: F.concat_ws("\x1f", x.k, x.v)))


def render_labels(labels: Column) -> Column:
    """``{k="v",...}`` by key; empty without labels."""
    pairs = F.transform(F.array_sort(labels), lambda x: F.concat(sanitize_name(x.k, False), F.lit('="'), escape_label(x.v), F.lit('"')))
    return F.when(F.size(labels) == 0, "").otherwise(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def console_lines(records: DataFrame) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return records.select("event_id", F.concat(stamp, F.lit(" "), F.upper("level"), F.lit(": "), "message").alias("line"))


def loki_streams(records: DataFrame) -> DataFrame:
    """Per level the number of records, and first and last line by time. The entries of a stream stay rows, in any number."""
    g = records.groupBy("level").agg(F.count(F.lit(1)).alias("entries"), F.min(F.struct("ts", "event_id", "message")).alias("a"), F.max(F.struct("ts", "event_id", "message")).alias("b"))
    return g.select("level", "entries", F.col("a.message").alias("first_message"), F.col("b.message").alias("last_message"))


def min_level(records: DataFrame, least: str) -> DataFrame:
    order = ["trace", "debug", "info", "warning", "error", "critical"]
    return records.filter(F.array_position(F.array(*map(F.lit, order)), F.col("level")) >= order.index(least) + 1)


def packed_lines(lines: DataFrame, limit: int = 1400) -> DataFrame:
    """Lines of each exporter joined greedily, in order, to payloads of at most ``limit`` bytes (an over-long line stands alone): ``exporter, seq, payload``."""

    def run(batches):
        import pyarrow as pa

        last, payload, size = object(), 0, 0
        for b in batches:
            keys, seqs, texts = (b.column(i) for i in range(3))
            out = []
            for k, t in zip(keys.to_pylist(), texts.to_pylist()):
                n = len((t or "").encode())
                if k != last:
                    last, payload, size = k, 0, n
                elif size + 1 + n > limit:
                    payload, size = payload + 1, n
                else:
                    size += 1 + n
                out.append(payload)
            yield pa.RecordBatch.from_arrays([keys, seqs, pa.array(out, pa.int64())], names=["exporter", "seq", "payload"])

    return lines.select("exporter", "seq", "line").repartition("exporter").sortWithinPartitions("exporter", "seq").mapInArrow(run, "exporter string, seq long, payload long")


#: Severity numbers and texts of exported records by level.
SEVERITY = {"trace": (1, "TRACE"), "debug": (5, "DEBUG"), "info": (9, "INFO"), "warning": (13, "WARN"), "error": (17, "ERROR"), "critical": (21, "FATAL")}


def otlp_logs(records: DataFrame) -> DataFrame:
    """A record a row as the exporter's JSON object."""
    number = F.element_at(F.create_map(*(F.lit(x) for k, (n, _) in SEVERITY.items() for x in (k, n))), F.col("level"))
    name = F.element_at(F.create_map(*(F.lit(x) for k, (_, t) in SEVERITY.items() for x in (k, t))), F.col("level"))
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    body = F.struct(F.col("message").alias("stringValue"))
    return records.select("event_id", F.to_json(F.struct(nanos.alias("timeUnixNano"), number.alias("severityNumber"), name.alias("severityText"), body.alias("body"))).alias("json"))


def otlp_sums(totals: DataFrame) -> DataFrame:
    """Delta sums as the exporter's JSON, a metric a row."""
    point = F.struct(F.array(F.struct(F.lit("status").alias("key"), F.struct(F.col("dim_value").alias("stringValue")).alias("value"))).alias("attributes"), F.col("total").cast("string").alias("asInt"))
    body = F.struct(F.lit("AGGREGATION_TEMPORALITY_DELTA").alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"), F.array(point).alias("dataPoints"))
    return totals.select("name", "dim_value", F.to_json(F.struct(F.col("name"), body.alias("sum"))).alias("json"))


def logfmt_lines(records: DataFrame) -> DataFrame:
    """``msg="..." key="..."``: backslashes and quotes escaped, line feeds as blanks."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit('"'))

    return records.select("event_id", F.concat(F.lit("msg="), quoted(F.col("message")), F.lit(" level="), quoted(F.col("level"))).alias("line"))


def json_lines(records: DataFrame) -> DataFrame:
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    return records.select("event_id", F.to_json(F.struct(stamp.alias("_time"), F.col("level"), F.col("message").alias("_msg"))).alias("line"))


def pool(allocations: DataFrame, pool_bytes: int, block_bytes: int, now: int, leak_after: int) -> DataFrame:
    """Use of a memory pool from its live allocations (``bytes, at``): percentages, and those held too long."""
    used = F.sum("bytes")
    blocks = F.sum(F.ceil(F.col("bytes") / block_bytes))
    return allocations.agg(used.cast("long").alias("used"), F.round(used / pool_bytes * 100, 4).alias("utilisation_percent"), F.round((1 - blocks / (pool_bytes // block_bytes)) * 100, 4).alias("free_blocks_percent"), F.count_if(F.lit(now) - F.col("at") >= leak_after).alias("leaks"))


def rates(runs: DataFrame) -> DataFrame:
    """Operations a second of each run; 0 where no time passed."""
    return runs.select("run", F.when(F.col("total_ns") == 0, 0.0).otherwise(F.round(F.col("n") * 1e9 / F.col("total_ns"), 4)).alias("ops_per_s"))
