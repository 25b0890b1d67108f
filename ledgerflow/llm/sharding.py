"""Shards of bounded size by extendible hashing, in DataFrame operations only.

A document's hash prefix names its bucket. Bytes are summed for all prefixes at
once (cells at some depth, rolled up to every shorter prefix), and each cell's
shard is the shortest prefix whose bytes fit the limit: just what splitting
oversized buckets bit by bit ends with. Cells that don't fit at that depth go
on to more bits. A key that alone exceeds the limit has shards of its own.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, writable

LIMIT_BYTES = 1 << 20
#: Bits of the hash: the first 15 hex digits of an MD5.
BITS = 60
SALTS = 64


def key_hash(key: Column) -> Column:
    """Non-negative 60-bit hash of a column's text; null has a value of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _depths(keys: DataFrame, limit: int, total: int) -> DataFrame:
    """``h, n, depth`` of each row of ``keys`` (``h, bytes, n``; ``total`` bytes in all): the bits of the shortest prefix of ``h`` that fits.

    No join broadcasts what grows with the keys, whatever sizes Spark takes the
    tables to have: prefixes meet by sort-merge joins, keys their cells by join_hot.
    """
    out, base = [], -1
    deep = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 6)
    while True:
        keys = keys.withColumn("cell", F.shiftright("h", BITS - deep))
        cells = materialize(keys.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("keys")), "cells")
        ups = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(base + 1), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        fit = materialize(ups.groupBy("depth", "prefix").agg(F.sum("bytes").alias("all")).filter(F.col("all") <= limit).select("depth", "prefix"), "fit")
        # What a prefix holds, longer ones can't exceed: the shortest that fits is the one without a shorter one by a bit that does.
        wider = fit.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        buckets = fit.withColumn("up", F.shiftright("prefix", 1)).join(wider.hint("merge"), ["depth", "up"], "left_anti")
        # 64 to 128 cells for each of the limit's share of the bytes, so a bucket's list of them stays short.
        of = buckets.select("depth", F.explode(F.expr(f"sequence(shiftleft(prefix, {deep} - depth), shiftleft(prefix + 1, {deep} - depth) - 1)")).alias("cell"))
        found = materialize(cells.select("cell", "keys").join(of.hint("merge"), "cell"), "directory")
        out.append(join_hot(keys, found, ["cell"], "keys", keys.count(), "h").filter("depth IS NOT NULL").select("h", "n", "depth"))
        over = cells.filter(F.col("bytes") > limit).select("cell")
        if deep == BITS or over.isEmpty():
            return reduce(DataFrame.unionByName, out)
        keys = materialize(keys.join(over.hint("merge"), "cell", "left_semi").select("h", "bytes", "n"), "split_keys")
        base, deep = deep, min(BITS, deep + 8)


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """``doc`` (a struct of the columns of ``docs``, or of ``carry``), ``shard_id, depth, bytes``.

    ``shard_id``: the prefix's bits. All rows of an id share a shard, whose texts
    have ``limit`` bytes (UTF-8) together at most; null text has none. An id whose
    rows alone have more is dealt, after a slash, into shards that keep to the
    limit unless a single text is over it. An empty table gives an empty result.
    """
    docs = writable(docs)
    columns = docs.columns if carry is None else carry
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), key_hash(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    keyed = materialize(keyed.withColumn("row", F.monotonically_increasing_id()), "keyed")
    keys = materialize(keyed.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("most")), "keys")
    giants = keys.filter(F.col("bytes") > limit).select("h", "n", F.lit(BITS).alias("depth"), "most")
    small = keys.filter(F.col("bytes") <= limit).select("h", "bytes", "n")
    total = small.agg(F.sum("bytes")).first()[0] or 0
    placed = materialize(_depths(small, limit, total).withColumn("most", F.lit(None).cast("long")).unionByName(giants).withColumn("rows", F.col("n")), "placed")
    out = join_hot(keyed, placed, ["h"], "rows", keyed.count(), "row")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"lpad(bin(shiftright(h, {BITS} - depth)), depth, '0')"))
    whole = out.filter("most IS NULL").select("doc", bits.alias("shard_id"), "depth", "bytes")
    # Rows of one id are dealt by a salt and numbered within it; as many share a shard as fit even if all are as long as the longest.
    salt = F.when(F.col("n") > 1, F.pmod(F.xxhash64("row"), F.lit(salts))).otherwise(0)
    place = F.row_number().over(Window.partitionBy("h", "salt").orderBy("row")) - 1
    own = F.expr(f"greatest(1, {limit} div greatest(most, 1))")
    dealt = out.filter("most IS NOT NULL").withColumn("salt", salt).withColumn("k", F.floor(place / own))
    dealt = dealt.select("doc", F.concat(bits, F.lit("/"), F.col("salt").cast("string"), F.lit("."), F.col("k").cast("string")).alias("shard_id"), "depth", "bytes")
    return whole.unionByName(dealt)


#: The shards of ``documents`` in DuckDB's SQL; ids are taken to be unique.
SHARD_SQL = """
WITH d AS (
  SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes
  FROM documents),
small AS (SELECT * FROM d WHERE bytes <= 1048576),
n AS (
  SELECT depth, h >> (60 - depth) AS prefix
  FROM small CROSS JOIN (SELECT CAST(unnest(generate_series(0, 60)) AS INTEGER) AS depth)
  GROUP BY ALL HAVING sum(bytes) <= 1048576),
s AS (SELECT d.doc_id, d.h, d.bytes, min(n.depth) AS depth FROM small d JOIN n ON n.prefix = d.h >> (60 - n.depth) GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(ltrim(bin(h >> (60 - depth)), '0'), depth, '0') END AS shard_id, depth, bytes FROM s
UNION ALL
SELECT doc_id, lpad(bin(h), 60, '0') || '/0.0', 60, bytes FROM d WHERE bytes > 1048576
"""
