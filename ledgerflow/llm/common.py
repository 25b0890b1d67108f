"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import discard, materialize, shared_dir

__all__ = ["discard", "extended", "fresh", "join_hot", "mapped", "materialize", "shared_dir", "sorted_runs", "words", "writable"]

#: Inside of a character class: the ASCII white space that separates words.
SPACE = r"\x20\x09-\x0D"
#: The same characters as a set for trim().
SPACE_CHARS = " \t\n\x0b\f\r"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``df`` has no such column (names are compared as Spark does by default)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def writable(df: DataFrame) -> DataFrame:
    """``df`` with columns of nulls without a type as strings, which files can hold."""
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and then the columns of ``ddl``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def mapped(df: DataFrame, run, ddl: str) -> DataFrame:
    """``df.mapInArrow(run)``, which adds the columns of ``ddl``; columns go by plain names meanwhile, since dots in names break it."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(run, extended(plain, ddl)).toDF(*df.columns, *StructType.fromDDL(ddl).names)


def words(text):
    """Array of the words of a string column; null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


#: Keys that hold more than one row in so many are hot; there can't be more such keys than that.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, by: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and in ``n`` the number of the key's rows, ``total`` in all; null where there is no such key.

    Hot keys, HOT_KEYS at most, are broadcast, and their rows are dealt over all
    tasks by the column ``by``; the others meet by a sort-merge join, whatever
    their size. The columns of ``on`` hold no nulls.
    """
    payload = [c for c in table.columns if c not in (*on, n)]
    hot = table.filter(F.col(n) > max(HOT_KEYS, total // HOT_KEYS)).select(*on, F.struct(*payload).alias("_hot"))
    part = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(by), F.lit(1 << 30))).otherwise(F.lit(0).cast("long"))
    spread = rows.join(F.broadcast(hot), on, "left").withColumn("_part", part)
    # Always 0, but not to the optimizer, which would drop a constant from the keys and so undo the dealing.
    zero = F.pmod(F.xxhash64(*on), F.lit(1)).cast("long")
    cold = table.select(*on, zero.alias("_part"), F.struct(*payload).alias("_cold"))
    out = spread.join(cold.hint("merge"), [*on, "_part"], "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in payload))


def sorted_runs(batches, key: str):
    """Yield the rows of each run of equal ``key`` as one pyarrow table, from batches that are sorted by it.

    Holds one run and one batch at a time, not the partition.
    """
    import numpy as np
    import pyarrow as pa

    kept: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if kept and keys[i] != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(i, j - i))
            last = keys[i]
    if kept:
        yield pa.Table.from_batches(kept)
