"""Exact deduplication as a stateful stream.

The normalised texts are written once as a content table. Its rows arrive as a stream of
(digest, identifier, length, locator); a keyed aggregation in the RocksDB state store keeps
one entry per digest without expiry: how many rows had it, the stable identifier of the row
that stays, and the locator of its content (file and row of the content table). The store
lives on disk and is checkpointed to the shared folder, so a lost executor resumes from
there. State and content table go when the result is written.

Every hit is then held against the full bytes: the texts of hits alone are fetched by their
locators and compared per digest. Texts that only share a digest are split into classes of
their own by their whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise, new_folder, remove

#: Fixed value: the characters that do not count when texts are compared.
SPACE = "[ \\t-\\r]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The store must not reserve disk space ahead: a few megabytes in each of many partitions add up.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed(docs: DataFrame, digest: Callable[[Column], Column] = sha256_of, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, length, digest, text_sha256, norm``: the content table; the stream carries all but the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("length"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    return rows.select("doc_id", "length", "digest", (F.lit(None).cast("string") if digest is sha256_of else sha256_of(F.col("norm"))).alias("text_sha256"), "norm")


def located(rows: DataFrame) -> DataFrame:
    """Rows of the content table with their locator instead of the text."""
    return rows.select("doc_id", "length", "digest", "text_sha256", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def _better() -> Column:
    """Least for the row that stays: the longest original text, then the smallest id (null last), then the first row of the content table."""
    return F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("locator"))


def grouped(rows: DataFrame) -> DataFrame:
    """The keyed state: per digest the row that stays, its locator and the number of rows."""
    return rows.groupBy("digest").agg(F.min(_better()).alias("best"), F.count("*").alias("group_size"))


def entry_schema(id_type: str) -> str:
    return f"digest string, best struct<shorter:bigint,unknown:boolean,doc_id:{id_type},locator:struct<file:string,row:bigint>>, group_size bigint"


def run_stream(source: DataFrame, state_dir: str, out_dir: str) -> None:
    """Drive ``source`` (a stream of keyed rows) to its end.

    Each micro-batch appends the entries that it changed with its number; the state itself
    stays in ``state_dir``. A batch that is run again after a failure replaces its own rows.
    """
    spark = source.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)

    def write(batch: DataFrame, number: int) -> None:
        batch.select("digest", "best", "group_size").write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    try:
        query = grouped(source).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest(spark: SparkSession, out_dir: str, id_type: str) -> DataFrame:
    """The last entry that the stream wrote for each digest: ``digest, keep_id, keep, group_size``."""
    rows = spark.read.schema(f"{entry_schema(id_type)}, batch bigint").parquet(out_dir)
    last = rows.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("e"))
    return last.select("digest", F.col("e.best.doc_id").alias("keep_id"), F.col("e.best.locator").alias("keep"), F.col("e.group_size").alias("group_size"))


def texts_at(rows: DataFrame, folder: str) -> DataFrame:
    """``digest, norm``: the texts of the content table's rows in ``rows(digest, locator)``; only their row groups are read."""

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for name, part in frame.groupby("file", sort=False):
                with store.open_input_file(f"{path}/{name}") as file:
                    content, first = pq.ParquetFile(file), 0
                    at, digest = part["row"].to_numpy(), part["digest"].to_numpy()
                    for k in range(content.num_row_groups):
                        end = first + content.metadata.row_group(k).num_rows
                        if len(own := np.nonzero((at >= first) & (at < end))[0]):
                            texts = content.read_row_group(k, columns=["norm"]).column(0)
                            for j in range(0, len(own), 1000):
                                some = own[j : j + 1000]
                                yield pd.DataFrame({"digest": digest[some], "norm": texts.take(at[some] - first).to_pylist()})
                        first = end

    flat = rows.select("digest", "locator.file", "locator.row").repartition("file").sortWithinPartitions("file", "row")
    return flat.mapInPandas(fetch, "digest string, norm string")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256_of, files_per_batch: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal when they are after deleting ASCII white space; null counts as empty,
    and all empty texts are equal. Of equal texts the row with the most code points in its
    original text stays, then the smallest id (a null id only if there is no other); ids of
    any type that can be ordered will do. Exactly one row of a group is kept, also where
    rows repeat an id and a text. An empty table gives an empty result; other columns are
    ignored. ``digest`` can be replaced (a weak one shows that full texts decide).
    """
    spark = docs.sparkSession
    table = new_folder(spark, "dedup-content")
    content = keyed(docs, digest, id_col, text_col)
    schema, id_type = T.StructType(content.schema.fields), content.schema["doc_id"].dataType.simpleString()
    content.write.parquet(table)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(table)
    out = new_folder(spark, "dedup-entries")
    spark.createDataFrame([], entry_schema(id_type)).write.parquet(f"{out}/batch=-1")
    state = new_folder(spark, "dedup-state")
    run_stream(located(stream), state, out)
    entries = materialise(latest(spark, out, id_type), "dedup-state-read")

    marked = materialise(located(spark.read.schema(schema).parquet(table)).join(entries, "digest"), "dedup-marked")
    false_hits = materialise(_false_hits(marked, table), "dedup-false")
    if not false_hits.isEmpty():
        split = _by_whole_text(spark.read.schema(schema).parquet(table), false_hits)
        marked = materialise(marked.join(false_hits, "digest", "left_anti").select(marked.columns).unionByName(split), "dedup-marked")
    for folder in (table, out, state):  # the result reads the marked rows only
        remove(spark, folder)
    kept = (F.col("locator.file") == F.col("keep.file")) & (F.col("locator.row") == F.col("keep.row"))
    return marked.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.coalesce("text_sha256", "digest").alias("text_sha256"))


def _false_hits(marked: DataFrame, table: str) -> DataFrame:
    """Digests that stand for several texts, by the full bytes of all rows that share one with another row."""
    texts = texts_at(marked.where("group_size > 1").select("digest", "locator"), table)
    return texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low != high").select("digest")


def _by_whole_text(content: DataFrame, false_hits: DataFrame) -> DataFrame:
    """Rows of these digests with the entry of their own whole text."""
    rows = materialise(located_with_text(content).join(false_hits, "digest"), "dedup-split")
    best = rows.groupBy("norm").agg(F.min(_better()).alias("best"), F.count("*").alias("group_size"))
    entry = best.select("norm", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep"), "group_size")
    return rows.join(entry, "norm").select("digest", "doc_id", "length", "text_sha256", "locator", "keep_id", "keep", "group_size")


def located_with_text(content: DataFrame) -> DataFrame:
    return content.select("doc_id", "length", "digest", "text_sha256", "norm", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))
