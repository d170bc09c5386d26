"""CRC shifts over arrays, and timelines put out in blocks."""

import zlib

import numpy as np

from cuemill.operators import fingerprint, timelines


def test_crc_shift():
    first = [b"", b"a", b"abc" * 9, bytes(range(256))]
    behind = [0, 1, 7, 4096, 3_000_001]
    pairs = [(a, n) for a in first for n in behind]
    shifted = fingerprint.crc_shift(np.array([zlib.crc32(a) for a, _ in pairs]), np.array([n for _, n in pairs]))
    for (a, n), got in zip(pairs, shifted):
        assert int(got) ^ zlib.crc32(bytes(n)) == zlib.crc32(a + bytes(n))


def test_merged_with_ties_of_nothing(spark):
    parts = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 3, zlib.crc32(b"abc")), (1, 2, 2, zlib.crc32(b"de")), (2, 0, 0, 0)], "file_id bigint, packet_index bigint, size bigint, crc bigint")
    got = {r.file_id: r.digest for r in fingerprint.crc32_merge(parts, ["file_id"]).collect()}
    assert got == {1: f"{zlib.crc32(b'abcde'):08x}", 2: "00000000"}


def test_timeline_in_blocks(spark):
    n = 2 * timelines.BLOCK + 3
    streams = spark.createDataFrame([(1, 0, n, 0), (2, 0, 0, 0), (3, 0, timelines.BLOCK, 0)], "file_id bigint, stream_index int, count bigint, start bigint")
    rows = timelines.stable_timeline(streams, (1, 1000), (1, 30))
    assert {(r.file_id, r["count"]) for r in rows.groupBy("file_id").count().collect()} == {(1, n), (3, timelines.BLOCK)}
    assert {r.ts for r in rows.where(f"n = {n - 1}").collect()} == {(n * 1000 * 2 + 30) // 60}
