"""Frames that are located and compared where their file lies."""

import hashlib

from pyspark.sql import functions as F

from cuemill.jobs import catalog
from cuemill.operators import fingerprint as FP
from cuemill.operators import mux
from cuemill.sources import containers


def test_errors_empty_files_and_frames(spark):
    head = mux.y4m_header(2, 2, (25, 1))
    rows = [(1, bytearray(head + b"FRAME\nabcdefFRAME\nghijklFRAME\nxx")), (2, bytearray(b"none")), (3, bytearray(head)), (4, None)]
    got = containers.y4m_packets(spark.createDataFrame(rows, "file_id bigint, content binary")).collect()
    frames = {(r.file_id, r.packet_index): bytes(r.payload) for r in got if r.error is None}
    assert frames == {(1, 0): b"abcdef", (1, 1): b"ghijkl"}
    assert sorted((r.file_id, r.error_kind, r.packet_index, r.flags) for r in got if r.error) == [(2, "EndOfFile", None, None), (4, "EndOfFile", None, None)]
    assert [c for c, _ in containers.y4m_packets(spark.createDataFrame(rows, "file_id bigint, content binary")).dtypes] == ["file_id", *[f.split()[0] for f in containers.PACKET.split(", ")], "error_kind", "error"]


def test_compared_where_they_lie(spark):
    """Same, different, missing and extra packets, and a file with no other version."""
    at = "array<struct<pos:bigint,size:bigint>>"
    two, three = [(0, 2), (2, 2)], [(1, 2), (3, 2), (5, 2)]
    rows = [(1, bytearray(b"aabb"), two, bytearray(b"_aabbcc"), three), (2, bytearray(b"aabb"), two, bytearray(b"_axbb"), three[:1]), (3, bytearray(b"aa"), two[:1], None, None), (4, bytearray(b""), None, bytearray(b""), None)]
    files = spark.createDataFrame(rows, f"file_id bigint, content binary, e {at}, other binary, a {at}")
    got = {(r.file_id, r.packet_index): (r.expected, r.actual, r.status) for r in FP.compare_packets(files, "content", F.col("e"), "other", F.col("a")).collect()}
    d = lambda b: hashlib.md5(b).hexdigest()
    assert got == {
        (1, 0): (d(b"aa"), d(b"aa"), "same"), (1, 1): (d(b"bb"), d(b"bb"), "same"), (1, 2): (None, d(b"cc"), "extra"),
        (2, 0): (d(b"aa"), d(b"ax"), "different"), (2, 1): (d(b"bb"), None, "missing"), (3, 0): (d(b"aa"), None, "missing"),
    }


def test_small_packets_do_not_travel(spark, sf_dir):
    """In verification and in the damaged files the only exchanges of documents are those of whole files."""
    for name in ("verified_containers", "damaged_files"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "packet_index" in line], name


def test_blocks_give_every_row(spark):
    """Packets behind the first block come from their own places."""
    from cuemill.sources import media

    data = bytes(i % 251 for i in range(6 * 2500 + 1))
    files = spark.createDataFrame([(1, "a", bytearray(data), len(data)), (2, "b", bytearray(b""), 0)], "file_id bigint, path string, content binary, length bigint")
    got = {r.packet_index: (r.pos, r.size, bytes(r.payload)) for r in media.packetize_pcm(files, 1, 3).collect()}
    assert got == {i: (6 * i, len(data[6 * i : 6 * i + 6]), data[6 * i : 6 * i + 6]) for i in range(2501)}


def test_files_are_packed_where_they_lie(spark):
    """The same files as those muxed from packets, over many rows and null and short contents; nothing is shuffled."""
    import pytest

    from cuemill.operators import stream_mux
    from cuemill.sources import media

    rows = [(f, bytearray(bytes((f + i) % 256 for i in range(f % 41)))) for f in range(300)] + [(300, None)]
    files = spark.createDataFrame(rows, "file_id bigint, content binary").withColumn("length", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint"))
    cases = (
        (stream_mux.y4m_layout(2, 2, (25, 1)), 6, lambda p: mux.mux_y4m(p, 2, 2, (25, 1)), 3),
        (stream_mux.avi_layout(2, 2, (25, 1)), 12, lambda p: mux.mux_avi(p.where("size = 12"), 2, 2, (25, 1)), 6),
        (stream_mux.wav_layout(48_000, 2), None, lambda p: mux.mux_wav(p, 48_000, 2), 512),
    )
    for layout, size, build, samples in cases:
        packed = stream_mux.packed(files, layout, size)
        assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
        got = packed.select("file_id", "content", "packed").collect()
        assert len(got) == 301 and {r.file_id: r.content for r in got} == {f: c and bytes(c) if c is None or c else b"" for f, c in rows}
        want = {r.file_id: bytes(r.content) for r in build(media.packetize_pcm(files, 1, samples)).collect()}
        assert {r.file_id: bytes(r.packed) for r in got if r.packed is not None} == want
    with pytest.raises(ValueError):
        stream_mux.packed(files, stream_mux.mov_layout([stream_mux.Track()]))


def test_verified_documents_are_shuffled_once(spark, sf_dir):
    """Both containers of a document are packed, read and compared behind one exchange of documents; digests alone travel besides."""
    plan = catalog.QUERIES["verified_containers"](spark, sf_dir)._jdf.queryExecution().executedPlan()
    plan.execute().count()
    lines = plan.toString().split("== Initial Plan ==")[0].splitlines()
    dealt = [line for line in lines if "REPARTITION_BY_NUM" in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1 and len(dealt) == 2
