"""Mixing sources to target weights by repeating documents at each source's rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words, writable

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 42
#: Rows of the table of sources up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target`` for each source of ``sizes`` (``source, size``).

    Sources weigh ``weights`` in turn, by code point, null last, and share the
    sum of all sizes. None gets more than ``max_repeat`` times its size; what is
    over goes to the others by weight until none is above. In order of size per
    weight the sources that stop at their limit come first, so the level follows
    from running sums; the windows see one row per source, not per document.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", max_repeat * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    final = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(Window.partitionBy())
    ranked = ranked.withColumn("final", final)
    return ranked.select("source", "source_size", F.when(F.col("weight") * F.col("final") < F.col("cap"), F.col("weight") * F.col("final")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """``doc`` (a struct of the columns of ``docs``, or of ``carry``), ``size, source_size, target, copies``.

    ``size`` is the number of words; null text has none. The source's rate is its
    target over its size; each document is taken floor(rate) times, and once more
    if a number made from the seed and its id (its text, if the id is null) is
    below the fraction. Reruns agree, repeated rows get the same copies, and no
    row is dropped: one with no copies stays with 0. A null source is a source of
    its own. An empty table gives an empty result. Extra columns may have any name.
    """
    docs = writable(docs)
    columns = docs.columns if carry is None else carry
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    sized = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))).alias("draw"),
    )
    # Texts aren't written here: the words are counted once for the sums and once more for the rows.
    to = materialize(targets(sized.select("source", "size"), weights, max_repeat), "targets")
    if to.count() <= BROADCAST_SOURCES:
        to = F.broadcast(to)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(to.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    copies = (F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.select("doc", "size", "source_size", "target", copies.alias("copies"))


#: The mix of ``documents`` in DuckDB's SQL.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
r AS (
  SELECT source, source_size, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST)),
f AS (SELECT *, max(CASE WHEN CAST(cap AS DOUBLE) / weight >= level THEN level END) OVER () AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN weight * final < cap THEN weight * final ELSE CAST(cap AS DOUBLE) END AS target FROM f),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.draw, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
