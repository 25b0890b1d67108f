"""Logs in files: JSON lines and one object per entry, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_WIDTH = 20

_WIRE = "term LONG, idx LONG, command STRING, type BYTE"


def key(idx: Column) -> Column:
    """An index as a key of 20 digits, so that keys sort as numbers."""
    return F.lpad(idx.cast("string"), KEY_WIDTH, "0")


def is_key(name: Column) -> Column:
    """Whether a name has the shape of a key: exactly 20 digits."""
    return name.rlike(f"^[0-9]{{{KEY_WIDTH}}}$")


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines log; commands are base64 in the file and binary in the table. Lines that aren't entries are nulls of ``idx``, dropped here."""
    return spark.read.schema(_WIRE).json(path).filter("idx IS NOT NULL").withColumn("command", F.unbase64("command"))


def write_json_log(entries: DataFrame, path: str, mode: str = "error") -> None:
    entries.select("term", "idx", F.base64("command").alias("command"), "type").write.mode(mode).json(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Every object below a folder, with its key and kind: entry, snapshot or other metadata. An entry whose key names another index than its body is a mismatch."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(is_key(name) & F.col("path").contains("/log/"), "entry").when(F.col("path").contains("/snapshots/"), "snapshot").otherwise("metadata")
    body = F.from_json(F.col("content").cast("string"), _WIRE)
    out = files.select("path", name.alias("key"), kind.alias("kind"), F.col("length").alias("size_bytes"), F.md5("content").alias("checksum_md5"), body.alias("entry"))
    return out.withColumn("mismatch", F.when(F.col("kind") == "entry", ~F.col("entry.idx").eqNullSafe(F.col("key").cast("long"))).otherwise(False))


def entry_to_json(entry: Column) -> Column:
    return F.to_json(F.struct(entry.term.alias("term"), entry.idx.alias("idx"), F.base64(entry.command).alias("command"), entry.type.alias("type")))
