"""Packet tables: numbering, filters, flags, statistics and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timebase
from ..sources.adapters import CORRUPT, DISCARD, KEY
from .running_totals import running

STREAM = ("file_id", "stream_index")


def flags_text(flags: Column) -> Column:
    """``K``, ``D`` and ``C`` in three places, ``_`` for what is unset."""
    return F.concat(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, letter).otherwise("_") for bit, letter in ((KEY, "K"), (DISCARD, "D"), (CORRUPT, "C"))])


def filter_packets(packets: DataFrame, stream_index: int | None = None, key_only: bool = False, drop_discarded: bool = False) -> DataFrame:
    """Row filters that the scan can push down as far as the source allows."""
    if stream_index is not None:
        packets = packets.where(F.col("stream_index") == stream_index)
    if key_only:
        packets = packets.where(F.col("flags").bitwiseAND(F.lit(KEY)) != 0)
    return packets.where(F.col("flags").bitwiseAND(F.lit(DISCARD)) == 0) if drop_discarded else packets


def number_frames(packets: DataFrame) -> DataFrame:
    """Per-stream frame numbers and running durations, both from 0, in write order."""
    found = running(packets, list(STREAM), "packet_index", {"frame_number": F.lit(1).cast("bigint"), "running_pts": F.col("duration")})
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("frame_number", "running_pts")})


def stream_stats(packets: DataFrame, dense: bool = True) -> DataFrame:
    """Packets, bytes, durations and the last written timestamps of every stream.

    "Last" is by write order even if that timestamp is null. With ``dense`` the streams
    0..max of a file are all listed, missing ones with zeros.
    """
    last = F.max_by(F.struct("pts", "dts"), "packet_index")
    found = packets.groupBy(*STREAM).agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"), F.sum("duration").alias("duration"), last.alias("last"))
    found = found.select(*STREAM, "packets", "bytes", "duration", F.col("last.pts").alias("last_pts"), F.col("last.dts").alias("last_dts"))
    if not dense:
        return found
    every = found.groupBy("file_id").agg(F.max("stream_index").alias("top")).select("file_id", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("stream_index"))
    zeros = {c: 0 for c in ("packets", "bytes", "duration")}
    return every.join(found, list(STREAM), "left").fillna(zeros)


def total_stats(packets: DataFrame) -> DataFrame:
    """Rows per stream, per file (stream null) and over all (file null too)."""
    return packets.rollup(*STREAM).agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("packets"), F.sum("size").alias("bytes"), F.sum("duration").alias("duration"))


def count_packets(streams: DataFrame, packets: DataFrame) -> DataFrame:
    """``nb_read_packets`` beside each stream, 0 when it has none; packets of unknown streams don't count."""
    counts = packets.groupBy(*STREAM).agg(F.count("*").alias("nb_read_packets"))
    return streams.join(counts, list(STREAM), "left").fillna({"nb_read_packets": 0})


def count_frames(streams: DataFrame) -> DataFrame:
    """``nb_read_frames`` as the container states it; nothing is decoded."""
    return streams.withColumn("nb_read_frames", F.col("nb_frames"))


def join_streams(packets: DataFrame, streams: DataFrame, columns: Sequence[str] = ("codec_type", "time_base")) -> DataFrame:
    """Stream attributes beside each packet."""
    return packets.join(streams.select(*STREAM, *columns), list(STREAM))


def orphan_packets(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets whose stream is unknown: an error in a report."""
    return packets.join(streams.select(*STREAM), list(STREAM), "left_anti")


def rescale_packets(packets: DataFrame, src: timebase.Rate, dst: timebase.Rate) -> DataFrame:
    """Timestamps in another time base; durations only if positive; nulls stay null.

    What overflows, or has an invalid source base, becomes null; a destination of 1/0 gives 0.
    """

    def to(c: str) -> Column:
        if not isinstance(dst, Column) and tuple(dst) == (1, 0):
            return F.when(F.col(c).isNotNull(), F.lit(0).cast("bigint"))
        return timebase.rescale_q(F.col(c), src, dst)

    return packets.withColumns({"pts": to("pts"), "dts": to("dts"), "duration": F.when(F.col("duration") > 0, to("duration")).otherwise(F.col("duration"))})


def in_write_order(packets: DataFrame) -> DataFrame:
    """A total order by file and packet, by range partitions."""
    return packets.orderBy("file_id", "packet_index")


def average_frame_rate(samples: Column, duration_ts: Column, timescale: Column) -> Column:
    """samples * timescale / duration in lowest terms; null where one of them is 0."""
    ok = (samples != 0) & (duration_ts != 0) & (timescale != 0)
    return F.when(ok, timebase.reduce_ratio(samples * timescale, duration_ts))


def sample_totals(stts: DataFrame) -> DataFrame:
    """Samples and media duration of every track from its run-length durations."""
    return stts.groupBy("file_id", "track").agg(F.sum("count").alias("samples"), F.sum(F.col("count") * F.col("value")).alias("media_duration"))


def dedup_by_digest(digests: DataFrame, path: str = "path") -> DataFrame:
    """Distinct payloads, how often each occurs, and its first place; counted map-side, so a frequent digest is no hot key."""
    return digests.groupBy("digest").agg(F.count("*").alias("copies"), F.min(path).alias("first_path"))
