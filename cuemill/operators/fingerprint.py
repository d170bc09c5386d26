"""Checksums per packet, stream and file, their text rows, and comparison.

Payloads are reduced to digests where they are read. Digests that must see the bytes of a
stream in order run over sorted partitions and hold one running state, never a group;
Adler-32 and CRC-32 of streams also come from per-packet parts without moving payloads.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..functions.blocks import exploded
from .running_totals import running

STREAM = ["file_id", "stream_index"]
PACKET = ["file_id", "packet_index", "stream_index", "pts", "dts", "duration", "size"]
ADLER = 65521


def framecrc(packets: DataFrame) -> DataFrame:
    """Timing and checksum of every packet, without its payload."""
    return packets.select(*PACKET, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(digests.framecrc(F.col("payload")))), 8, "0")).alias("checksum"))


def framehash(packets: DataFrame, algorithm: str = "SHA256") -> DataFrame:
    return packets.select(*PACKET, digests.hash_hex(F.col("payload"), algorithm).alias("digest"))


class _Running:
    """A digest that is fed piece by piece."""

    def __init__(self, name: str):
        name = digests.algorithm(name)
        if name in ("CRC32", "adler32"):
            self.f, self.value, self.h = (zlib.crc32 if name == "CRC32" else zlib.adler32), (0 if name == "CRC32" else 1), None
        else:
            self.h = hashlib.new({"SHA160": "sha1"}.get(name, name.lower().replace("/", "_")))

    def add(self, data: bytes) -> None:
        if self.h is None:
            self.value = self.f(data, self.value)
        else:
            self.h.update(data)

    def hex(self) -> str:
        return f"{self.value:08x}" if self.h is None else self.h.hexdigest()


def _ordered(packets: DataFrame, keys: list[str], algorithm: str) -> DataFrame:
    kinds = ", ".join(f"{k} {packets.schema[k].dataType.simpleString()}" for k in keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows, count, size = None, None, [], 0, 0
        for batch in batches:
            columns = batch.to_pydict()
            for *key, payload in zip(*(columns[k] for k in keys), columns["payload"]):
                if key != now:
                    if state is not None:
                        rows.append((*now, state.hex(), count, size))
                    now, state, count, size = key, _Running(algorithm), 0, 0
                state.add(payload or b"")
                count, size = count + 1, size + len(payload or b"")
            if rows:
                yield made(rows)
                rows = []
        if state is not None:
            yield made([(*now, state.hex(), count, size)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        names = [*keys, "digest", "packets", "bytes"]
        return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema)

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([*((k, arrow[packets.schema[k].dataType.simpleString()]) for k in keys), ("digest", pa.string()), ("packets", pa.int64()), ("bytes", pa.int64())])
    dealt = packets.select(*keys, "packet_index", "payload").repartition(*keys).sortWithinPartitions(*keys, "packet_index")
    return dealt.select(*keys, "payload").mapInArrow(fold, f"{kinds}, digest string, packets bigint, bytes bigint")


def streamhash(packets: DataFrame, algorithm: str = "SHA256") -> DataFrame:
    """One digest per stream over its payloads in write order."""
    return _ordered(packets, STREAM, algorithm)


def filehash(packets: DataFrame, algorithm: str = "SHA256") -> DataFrame:
    """One digest per file over all payloads in write order; empty packets count."""
    return _ordered(packets, ["file_id"], algorithm)


def type_conflicts(packets: DataFrame) -> DataFrame:
    """Streams whose packets don't all have one type."""
    kinds = packets.groupBy(*STREAM).agg(F.count_distinct("codec_type").alias("types"))
    return kinds.where("types > 1")


def adler_parts(payload: Column) -> tuple[Column, Column]:
    """Sums a and b of the checksum that starts from 0, as BIGINTs."""
    value = digests.framecrc(payload)
    return value.bitwiseAND(F.lit(0xFFFF)), F.shiftright(value, 16)


def _with_bytes_after(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``after``, the bytes of a key's packets behind each one: a running sum from the last packet on, in blocks."""
    return running(parts, keys, "packet_index", {"after": F.col("size")}, reverse=True).withColumn("after", F.coalesce("after", F.lit(0)))


def adler32_merge(parts: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """Adler-32 of each key's concatenated payloads from ``packet_index, size, a, b`` of its packets.

    b of the whole adds, for each packet, its a once for every byte after it.
    """
    each = _with_bytes_after(parts, keys).select(*keys, "size", "a", ((F.col("b") + (F.col("after") % ADLER) * F.col("a")) % ADLER).alias("part"))
    sums = each.groupBy(*keys).agg((F.sum("a") % ADLER).alias("a"), (F.sum("part") % ADLER).alias("b"), F.sum("size").alias("n"))
    a, b = (F.col("a") + seed) % ADLER, (F.col("b") + F.lit(seed) * (F.col("n") % ADLER)) % ADLER
    return sums.select(*keys, F.lpad(F.lower(F.hex(F.shiftleft(b, 16) + a)), 8, "0").alias("digest"))


# --- CRC-32 over GF(2)

#: Fixed value: the reversed CRC-32 polynomial.
POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """Products of polynomials ``a`` with ``b`` modulo the CRC's, lowest power in the highest bit."""
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> bit & 1, b, 0)
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each of ``crc`` becomes under its number of zero bytes, without pre- and post-conditioning; one step for each bit of the largest number."""
    crc, n, power = crc.astype(np.int64), n_bytes.astype(np.int64), 1 << 23  # x^8
    while n.any():
        odd = (n & 1) == 1
        crc[odd] = _times(crc[odd], power)
        power, n = int(_times(np.array([power]), power)[0]), n >> 1
    return crc


def crc32_merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """CRC-32 of each key's concatenated payloads from ``packet_index, size, crc``: each part shifted by the bytes after it, then combined by XOR."""

    @F.pandas_udf("bigint")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(), after.to_numpy()))

    each = _with_bytes_after(parts, keys).select(*keys, "crc", "after").withColumn("part", shifted("crc", "after"))
    return each.groupBy(*keys).agg(F.lpad(F.lower(F.hex(F.bit_xor("part"))), 8, "0").alias("digest"))


# --- text rows


def _ts(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))


def _packet_line(last: Column) -> Column:
    right = lambda text, n: F.when(F.length(text) >= n, text).otherwise(F.lpad(text, n, " "))
    return F.concat_ws(", ", F.col("stream_index").cast("string"), right(_ts("dts"), 10), right(_ts("pts"), 10), right(F.col("duration").cast("string"), 8), right(F.col("size").cast("string"), 8), last)


def framecrc_lines(rows: DataFrame) -> DataFrame:
    """``file_id, packet_index, line``: decode before presentation time, then duration, size and checksum."""
    return rows.select("file_id", "packet_index", _packet_line(F.col("checksum")).alias("line"))


def framehash_lines(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "packet_index", _packet_line(F.col("digest")).alias("line"))


def framehash_header(algorithm: str) -> list[str]:
    return ["#format: frame checksums", "#version: 2", f"#hash: {digests.muxer_name(algorithm)}", "#stream#, dts,        pts, duration,     size, hash"]


def streamhash_lines(rows: DataFrame, algorithm: str) -> DataFrame:
    """``index,type,NAME=hex``; the type is a letter: v, a, s, d or ?."""
    letter = F.when(F.col("codec_type").isin("video", "audio", "subtitle", "data"), F.substring("codec_type", 1, 1)).otherwise("?")
    return rows.select(*STREAM, F.concat(F.col("stream_index").cast("string"), F.lit(","), letter, F.lit(f",{digests.muxer_name(algorithm)}="), F.col("digest")).alias("line"))


def hash_lines(rows: DataFrame, algorithm: str) -> DataFrame:
    return rows.select("file_id", F.concat(F.lit(f"{digests.muxer_name(algorithm)}="), F.col("digest")).alias("line"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Text files in a total order, by range partitions."""
    lines.orderBy(*order).select("line").write.text(path)


# --- comparison


def compare(expected: DataFrame, actual: DataFrame, value: str = "digest", keys: tuple[str, ...] = ("file_id", "stream_index", "packet_index")) -> DataFrame:
    """``status`` same, different, missing or extra for every row of either side."""
    e = expected.select(*keys, F.col(value).alias("expected"))
    a = actual.select(*keys, F.col(value).alias("actual"))
    return e.join(a, list(keys), "full").select(*keys, "expected", "actual", _status().alias("status"))


def _status() -> Column:
    return F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") == F.col("actual"), "same").otherwise("different")


def compare_packets(files: DataFrame, expected: str, expected_at: Column, actual: str, actual_at: Column) -> DataFrame:
    """``compare`` by MD5 of the packets of one stream in two versions of each file, whose bytes are the columns ``expected`` and ``actual``.

    ``.._at`` are lists of ``pos, size`` of the packets, numbered from 0. Packets are met and
    digested where their file lies: where lists of digests would be many times larger than
    small packets, only files travel.
    """
    none = F.array().cast("array<struct<pos:bigint,size:bigint>>")
    files = files.select("file_id", expected, actual, F.coalesce(expected_at, none).alias("_e"), F.coalesce(actual_at, none).alias("_a"))

    def digest(content: Column, at: Column) -> Column:
        return F.when(at.isNotNull(), F.md5(F.substring(content, (at["pos"] + 1).cast("int"), at["size"].cast("int"))))

    def pair(i: Column, v: Column) -> Column:
        e, a = F.get(v["_e"], i.cast("int")), F.get(v["_a"], i.cast("int"))
        return F.struct(i.alias("i"), digest(v[expected], e).alias("e"), digest(v[actual], a).alias("a"))

    rows = exploded(files, F.greatest(F.size("_e"), F.size("_a")), pair, ["file_id"], [expected, actual, "_e", "_a"])
    rows = rows.select("file_id", F.lit(0).alias("stream_index"), F.col("_x.i").alias("packet_index"), F.col("_x.e").alias("expected"), F.col("_x.a").alias("actual"))
    return rows.withColumn("status", _status())


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a, with repeats, that b doesn't have."""
    return a.exceptAll(b)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def in_either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()
