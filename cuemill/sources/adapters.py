"""Plain tables as media: packets, files and sample tables with the usual keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, DISCARD, CORRUPT = 1, 4, 2


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def numbered_kinds(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column with their rank; as small as the set of kinds."""
    kinds = df.select(column).distinct()
    return kinds.withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)


def packets_from_events(events: DataFrame) -> DataFrame:
    """One file per user, one stream per event type; time base 1/1000000."""
    kinds = numbered_kinds(events, "event_type", "stream_index")
    order = Window.partitionBy("file_id").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").alias("file_id"), "ts", "event_id", "event_type", micros(F.col("ts")).alias("pts"), F.floor(F.col("value") * 1000 + 0.5).cast("bigint").alias("duration"), F.coalesce("props", F.lit("")).cast("binary").alias("payload"))
    rows = rows.join(kinds, "event_type").withColumn("packet_index", F.row_number().over(order) - 1)
    return rows.select("file_id", "packet_index", "stream_index", "event_type", "pts", F.col("pts").alias("dts"), "duration", F.octet_length("payload").cast("bigint").alias("size"), F.when(F.col("event_type") == "purchase", KEY).otherwise(0).alias("flags"), "payload")


def packets_from_conversations(turns: DataFrame) -> DataFrame:
    """One file per conversation, one stream per role; a turn is one packet."""
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return turns.select(F.col("conv_id").alias("file_id"), F.col("turn").cast("bigint").alias("packet_index"), role.alias("stream_index"), F.col("turn").cast("bigint").alias("pts"), F.col("turn").cast("bigint").alias("dts"), F.lit(1).cast("bigint").alias("duration"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"), F.lit(KEY).alias("flags"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))


def files_from_documents(docs: DataFrame) -> DataFrame:
    content = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), content.alias("content"), F.octet_length(content).cast("bigint").alias("length"))


def files_from_pages(pages: DataFrame) -> DataFrame:
    content = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(F.col("page_id").alias("file_id"), F.col("url").alias("path"), content.alias("content"), F.octet_length(content).cast("bigint").alias("length"))


def sample_tables_from_lineitem(lines: DataFrame) -> dict[str, DataFrame]:
    """Run-length sample tables, one track per order.

    A line is a run of samples with one duration and one size; every chunk of the track
    holds three samples up to the second chunk and two from then on.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    runs = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumn("ord", F.row_number().over(order))  # values are made behind the window, so that all tables share the exchange below it
    key, count = [F.col("l_orderkey").alias("file_id"), F.lit(0).alias("track"), "ord"], F.col("l_quantity").cast("bigint").alias("count")
    stts = runs.select(*key, count, (F.col("l_suppkey") + 1).cast("bigint").alias("value"))
    ctts = runs.select(*key, count, (F.col("l_partkey") % 5).cast("bigint").alias("value"))
    sizes = runs.select(*key, count, (F.col("l_partkey") + 1).cast("bigint").alias("value"))
    stsc = runs.where("ord <= 2").select(*key, (F.when(F.col("ord") == 1, 1).otherwise(3)).cast("bigint").alias("first_chunk"), (F.when(F.col("ord") == 1, 3).otherwise(2)).cast("bigint").alias("samples_per_chunk"))
    return {"stts": stts, "ctts": ctts, "stsz_runs": sizes, "stsc": stsc}
