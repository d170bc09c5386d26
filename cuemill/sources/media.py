"""Files as rows, and packets cut from raw bytes by arithmetic alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import exploded

#: Files from this size on are not read as one row.
MOST_BYTES = 1 << 30


def read_media(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``file_id, path, length, modificationTime, content`` of files, and the quarantine rows of those too large for a row."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = found.select(F.col("path").alias("file_id"), "path", "length", "modificationTime", "content")
    large = found.where(F.col("length") > most_bytes).select(F.col("path").alias("file_id"), F.lit("read").alias("stage"), F.lit("Unsupported").alias("error_kind"), F.lit("file is too large for one row").alias("error"))
    return rows.where(F.col("length") <= most_bytes), large


def split_errors(parsed: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and quarantine rows ``file_id, stage, error_kind, error``."""
    bad = parsed.where("error is not null").select("file_id", F.lit(stage).alias("stage"), "error_kind", "error")
    return parsed.where("error is null").drop("error_kind", "error"), bad


def _slices(files: DataFrame, packet_bytes: Column) -> DataFrame:
    n = F.ceil(F.col("length") / packet_bytes).cast("bigint")
    rows = files.withColumn("_size", packet_bytes.cast("bigint")).where((F.col("length") > 0) & (F.col("_size") > 0))

    def piece(i: Column, v: Column) -> Column:
        return F.struct(i.alias("i"), F.substring(v["content"], (i * v["_size"] + 1).cast("int"), v["_size"].cast("int")).alias("payload"))

    rows = exploded(rows, n, piece, ["file_id", "length", "_size"], ["content", "_size"])
    rows = rows.select("file_id", "length", "_size", F.col("_x.i").alias("packet_index"), F.col("_x.payload").alias("payload"))
    at = F.col("packet_index") * F.col("_size")
    return rows.withColumn("pos", at).withColumn("size", F.least(F.col("_size"), F.col("length") - at))


def packetize_pcm(files: DataFrame, channels: int = 1, packet_samples: int = 1024) -> DataFrame:
    """s16le packets of ``packet_samples`` sample frames; the last may be short. Timestamps count sample frames.

    A packet that ends within a sample frame counts its whole ones; only the last can, so
    timestamps have a closed form.
    """
    frame = 2 * channels
    rows = _slices(files, F.lit(packet_samples * frame))
    pts = F.col("packet_index") * packet_samples
    return rows.select("file_id", "packet_index", F.lit(0).alias("stream_index"), pts.alias("pts"), pts.alias("dts"), F.floor(F.col("size") / frame).alias("duration"), "size", "pos", F.lit(1).alias("flags"), "payload")


def packetize_rawvideo(files: DataFrame, frame_bytes: int) -> tuple[DataFrame, DataFrame]:
    """One packet per whole frame, and quarantine rows of files whose length is no multiple of a frame."""
    whole = F.col("length") % frame_bytes == 0
    rows = _slices(files.where(whole), F.lit(frame_bytes))
    packets = rows.select("file_id", "packet_index", F.lit(0).alias("stream_index"), F.col("packet_index").alias("pts"), F.col("packet_index").alias("dts"), F.lit(1).cast("bigint").alias("duration"), "size", "pos", F.lit(1).alias("flags"), "payload")
    bad = files.where(~whole).select("file_id", F.lit("rawvideo").alias("stage"), F.lit("InvalidData").alias("error_kind"), F.concat(F.lit("length "), F.col("length").cast("string"), F.lit(f" is no multiple of the frame size {frame_bytes}")).alias("error"))
    return packets, bad


# --- numbered images


def split_pattern(pattern: str) -> tuple[str, int | None, str] | None:
    """Prefix, width and suffix of ``name-%05d.png``; None if there is no number. ``%%`` is a percent sign."""
    found = re.split(r"%(%|\d*d)", pattern)
    texts, specs, now = [], [], found[0]
    for spec, text in zip(found[1::2], found[2::2]):
        if spec == "%":
            now += "%" + text
        else:
            texts.append(now)
            specs.append(spec)
            now = text
    texts.append(now)
    if "%" in "".join(found[::2]) or len(specs) > 1:
        raise ValueError(f"unsupported pattern {pattern!r}")
    if not specs:
        return None
    width = specs[0][:-1]
    if width and int(width) == 0:
        raise ValueError("the width must be positive")
    return texts[0], int(width) if width else None, texts[1]


def frame_number(path: Column, pattern: str) -> Column:
    """The number in a path that fits the pattern, else null. At least ``width`` digits; more are fine."""
    parts = split_pattern(pattern)
    if parts is None:
        return F.when(path == pattern.replace("%%", "%"), F.lit(0).cast("bigint"))
    prefix, width, suffix = parts
    digits = F.regexp_extract(path, f"^{re.escape(prefix)}([0-9]{{{width or 1},18}}){re.escape(suffix)}$", 1)
    return F.nullif(digits, F.lit("")).cast("bigint")


def number_path(number: Column, pattern: str) -> Column:
    """The path of a frame number."""
    prefix, width, suffix = split_pattern(pattern) or (pattern.replace("%%", "%"), None, "")
    if split_pattern(pattern) is None:
        return F.lit(prefix)
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= (width or 1), text).otherwise(F.lpad(text, width or 1, "0")), F.lit(suffix))


def contiguous_run(numbers: DataFrame, keys: list[str], number: str = "number", start_number: int = 0, window: int = 5) -> DataFrame:
    """Rows of the first unbroken run that begins in ``start_number .. start_number + window - 1``, with ``pts`` from 0.

    A group whose first number lies beyond that has no rows; numbers must be distinct in a group.
    The run ends at the least number whose successor is missing, which an anti-join on
    numbers finds; only keys and numbers take part, other columns (payloads) wait for the
    bounds of their group, one row each.
    """
    narrow = numbers.where(F.col(number) >= start_number).select(*keys, F.col(number).alias("_n"))
    successors = narrow.select(*[F.col(k).alias(f"_s_{k}") for k in keys], (F.col("_n") - 1).alias("_s_n"))
    follows = F.col("_n") == F.col("_s_n")
    for k in keys:
        follows = follows & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    ends = narrow.join(successors, follows, "left_anti").groupBy(*keys).agg(F.min("_n").alias("_end"))
    firsts = narrow.groupBy(*keys).agg(F.min("_n").alias("_first")).where(F.col("_first") < start_number + window)
    b = firsts.join(ends.select(*[F.col(k).alias(f"_e_{k}") for k in keys], "_end"), _equal(keys, "", "_e_")).select(*[F.col(k).alias(f"_b_{k}") for k in keys], "_first", "_end")
    run = numbers.join(b, _equal(keys, "", "_b_") & F.col(number).between(F.col("_first"), F.col("_end")))
    return run.select(*numbers.columns, (F.col(number) - F.col("_first")).alias("pts"))


def _equal(keys: list[str], a: str, b: str) -> Column:
    """Keys with two prefixes are the same, nulls included."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(a + k).eqNullSafe(F.col(b + k))
    return out


def image_sequence(files: DataFrame, pattern: str, start_number: int = 0) -> tuple[DataFrame, DataFrame]:
    """Packets of one numbered image sequence, and quarantine rows for repeated numbers, or for a start that isn't there."""
    numbered = files.withColumn("number", frame_number(F.col("path"), pattern)).where("number is not null")
    sequence = F.lit(pattern).alias("sequence")
    counts = numbered.groupBy("number").agg(F.count("*").alias("n"))
    bad = counts.where("n > 1").select(F.lit(pattern).alias("file_id"), F.lit("image2").alias("stage"), F.lit("InvalidData").alias("error_kind"), F.concat(F.lit("duplicate frame number "), F.col("number").cast("string")).alias("error"))
    start = numbered.where(F.col("number") >= start_number).agg(F.min("number").alias("first"))
    late = start.where(F.col("first").isNull() | (F.col("first") > start_number + 4)).select(F.lit(pattern).alias("file_id"), F.lit("image2").alias("stage"), F.lit("InvalidData").alias("error_kind"), F.lit(f"no frame number from {start_number} on").alias("error"))
    run = contiguous_run(numbered.select("*", sequence), ["sequence"], "number", start_number)
    packets = run.select(F.col("sequence").alias("file_id"), F.col("pts").alias("packet_index"), F.lit(0).alias("stream_index"), "pts", F.col("pts").alias("dts"), F.lit(1).cast("bigint").alias("duration"), F.col("length").alias("size"), F.lit(1).alias("flags"), F.col("path").alias("image_path"), F.col("content").alias("payload"))
    return packets, bad.unionByName(late)


def union_packets(*tables: DataFrame) -> DataFrame:
    """One packet model for all sources: columns by name, missing ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
