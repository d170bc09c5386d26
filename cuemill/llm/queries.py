"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, maxent, mixing, multiset_hash, outliers, packing, periodic_runs, preference, simhash, stream_dedup, token_counts, whitening, zip_warc
from .sql import ORACLES


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, which is installed at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """The packing of op2 and of the pipeline: 2048 tokens, end token 0; of a longer document's pieces the first may be shorter."""
    import public_tokenizers

    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 2048, 0, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.pair_digests(*preference.last_reply_pairs(table(spark, sf_dir, "conversations")))


def op9_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_warc.round_trip(table(spark, sf_dir, "pages"))


def op10_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality(table(spark, sf_dir, "documents")).drop("d")


def op11_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_packing, op3_maxent, op4_simhash, op5_line_dedup, op6_mixing, op7_stream_dedup, op8_preference, op9_zip_warc, op10_outliers,
        op11_multiset_hash, op12_periodic_runs, op13_whitening,
    )
}
ORACLE_SQL = ORACLES
