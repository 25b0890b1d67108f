"""Backups: manifests against stored objects, log continuity, certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import is_key


def object_problems(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """The first problem of each object of the manifest: missing, then size, then checksum."""
    s = stored.select("key_suffix", F.col("size_chars").alias("_size"), F.col("checksum_md5").alias("_md5"))
    j = manifest.join(s, "key_suffix", "left")
    p = F.when(F.col("_md5").isNull(), "missing").when(F.col("_size") != F.col("size_chars"), "size_mismatch").when(F.col("_md5") != F.col("checksum_md5"), "checksum_mismatch")
    return j.withColumn("problem", p).filter("problem IS NOT NULL").select("key_suffix", "problem")


def missing(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    return manifest.join(stored, "key_suffix", "left_anti").select("key_suffix")


def bad_keys(manifest: DataFrame) -> DataFrame:
    return manifest.filter(~is_key(F.col("key_suffix"))).select("key_suffix")


def gaps(log: DataFrame, snapshot_index: int) -> DataFrame:
    """Places where the log doesn't go on: after the snapshot, or between entries. A missing predecessor is found by an anti join, in any number of tasks."""
    prev = log.select((F.col("idx") + 1).alias("idx"))
    return log.select("idx").join(prev, "idx", "left_anti").filter(F.col("idx") != snapshot_index + 1)


def term_regressions(log: DataFrame, manifest_term: int) -> DataFrame:
    return log.filter(F.col("term").isNull() | (F.col("term") > manifest_term)).select("idx", "term")


def ledger(events: DataFrame) -> DataFrame:
    """Certificates by serial: issued first at ``issued_at``; each later revocation overwrites ``revoked_at``, earlier ones found no such serial."""
    issued, revoked = F.min(F.when(F.col("kind") == "issue", F.col("idx"))), F.max(F.when(F.col("kind") == "revoke", F.col("idx")))
    by = events.groupBy("serial").agg(issued.alias("issued_at"), revoked.alias("_last")).filter("issued_at IS NOT NULL")
    return by.select("serial", "issued_at", F.when(F.col("_last") > F.col("issued_at"), F.col("_last")).alias("revoked_at"))


def unknown_revocations(events: DataFrame) -> DataFrame:
    """Revocations that are answered with ``serial_not_found``: of serials not issued before them."""
    issued = events.filter("kind = 'issue'").groupBy("serial").agg(F.min("idx").alias("_issued"))
    return events.filter("kind = 'revoke'").join(issued, "serial", "left").filter("_issued IS NULL OR idx < _issued").select("serial", "idx")


def verified(manifest: DataFrame, stored: DataFrame, log: DataFrame, snapshot_index: int, term: int) -> DataFrame:
    """All problems of a backup as ``problem, at``: of its objects, keys, the log's continuity and its terms."""
    parts = (
        object_problems(manifest, stored).select("problem", F.col("key_suffix").alias("at")),
        bad_keys(manifest).select(F.lit("bad_key").alias("problem"), F.col("key_suffix").alias("at")),
        gaps(log, snapshot_index).select(F.lit("gap").alias("problem"), F.col("idx").cast("string").alias("at")),
        term_regressions(log, term).select(F.lit("term_regression").alias("problem"), F.col("idx").cast("string").alias("at")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def created(log: DataFrame, group: str) -> DataFrame:
    """A backup's manifest row for each ``group``: its entries' range, number, bytes and last term."""
    return log.groupBy(group).agg(F.min("idx").alias("first_index"), F.max("idx").alias("last_index"), F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("command")).cast("long").alias("bytes"), F.max_by("term", "idx").alias("last_term"))


def next_serials(events: DataFrame) -> DataFrame:
    """The serial that the next certificate gets: one more than the highest issued."""
    return events.filter("kind = 'issue'").agg((F.coalesce(F.max("serial"), F.lit(0)) + 1).alias("next_serial"))


def crl(certificates: DataFrame) -> DataFrame:
    return certificates.filter("revoked_at IS NOT NULL").select("serial", "revoked_at")


def newest_snapshots(snapshots: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("node_id").orderBy(F.col("last_included_index").desc())
    return snapshots.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep).drop("_k")


def merged_digests(digests: DataFrame) -> DataFrame:
    """Each node's greatest (term, last index)."""
    return digests.groupBy("node_id").agg(F.max(F.struct("term", "last_log_index")).alias("d")).select("node_id", "d.term", "d.last_log_index")


def catch_up_sources(digests: DataFrame, members: DataFrame, self_id: int, needed: int) -> DataFrame:
    """Members, but oneself, that hold an index; the least by id is the one to ask."""
    ok = digests.join(members, "node_id", "left_semi").filter((F.col("node_id") != self_id) & (F.col("last_log_index") >= needed))
    return ok.agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("sources"))
