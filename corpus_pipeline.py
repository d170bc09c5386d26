"""A training-data pipeline over ``documents``, each stage one of the corpus operators.

Every stage works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns one row per piece with its sequence and place there.

A row is known by its id and two hashes of all its columns, so rows without an id, and rows
that repeat one with another text, have verdicts of their own. Rows that are alike in every
column are one document, of which the deduplicating stages keep one and the mix as many as
it takes. Of equal or similar texts the smallest known ids come first, null ids last. Null
texts count as empty and fail the quality rules; other stages take them as they are. Null
languages and sources are groups of their own. Empty tables pass through as empty tables,
extra columns of types that can be hashed (no maps) stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import mixing, near_jaccard, outliers, stream_dedup
from cuemill.llm.queries import packed
from cuemill.llm.storage import materialise

def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """Adds the key of a row under a name of its own; keys are in the order of the ids."""
    values = [c for name in docs.columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    key = fresh(docs, "_row_key")
    return docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))), key


def same(docs: DataFrame) -> list:
    """The columns of ``docs``, also those with dots in their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def chosen(known: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``known`` that ``keys(doc_id)`` names."""
    return known.join(keys.select(F.col("doc_id").alias(key)), key, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    known, key = with_key(docs)
    return chosen(known, key, outliers.quality(known, id_col=key).where("kept")).select(*same(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that stays."""
    known, key = with_key(docs)
    return chosen(known, key, stream_dedup.exact_duplicates(known, id_col=key).where("kept")).dropDuplicates([key]).select(*same(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word Jaccard similarity of 0.8 or more: the one with the smallest id.

    Candidates come from SimHash fingerprints in vantage-point trees, as in op4, and from
    MinHash bands for what differs in more than 4 bits; all are checked exactly.
    """
    known, key = with_key(docs)
    return chosen(known, key, near_jaccard.near_duplicates(known, id_col=key).where("doc_id = component_id")).dropDuplicates([key]).select(*same(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    known, key = with_key(docs)
    number, place = fresh(known, "_copies"), fresh(known, "_copy")
    copies = mixing.mixed(known.select("doc_id", "text", "source", key), carry=(key,)).where("copies > 0").groupBy(key).agg(F.sum("copies").cast("int").alias(number))
    taken = known.join(copies, key).dropDuplicates([key])
    return taken.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(number)))).select(*same(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Tokenizers, streams and XXH64 are beyond DuckDB's SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
