"""From raw documents to packed sequences: quality, near-duplicates, personal data, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import mixing, packing, pii, quality, simhash
from ledgerflow.llm.common import materialize
from ledgerflow.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return quality.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the one of the least id, of repeated rows one. Rows with a null id stay only where no other row is like them."""
    docs = docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id())
    first = simhash.near_duplicates(docs, size=5, similarity=0.8, row_col="row").filter("first").select("row")
    return docs.join(first.hint("merge"), "row", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of its kinds."""
    clean = pii.find(docs.select(*COLUMNS), redact=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    mixed = mixing.mix(docs.select(*COLUMNS)).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, without the ids."""
    return packing.pack(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The models (votes, field, tokenizer, column generation) have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
