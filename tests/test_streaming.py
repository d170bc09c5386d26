"""Streams give what the batch operators give."""

import zlib

from pyspark.sql import functions as F

from cuemill.jobs import catalog, stream_queries
from cuemill.jobs.fingerprint_queries import turn_packets
from cuemill.streaming import running


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.select(*columns).collect())


def test_running_digests(spark, sf_dir):
    got = {(r.file_id, r.stream_index): r.digest for r in stream_queries.digest_rows(spark, sf_dir).collect()}
    whole: dict = {}
    for r in turn_packets(spark, sf_dir).orderBy("packet_index").collect():
        whole.setdefault((r.file_id, r.stream_index), []).append(bytes(r.payload))
    assert got == {k: f"{zlib.crc32(b''.join(v)):08x}" for k, v in whole.items()}
    merged = {(r.file_id, r.stream_index): r.digest for r in catalog.QUERIES["crc32_of_streams"](spark, sf_dir).collect()}
    assert merged == got


def test_running_rescale(spark, sf_dir):
    assert rows(catalog.QUERIES["rescale_delta_running"](spark, sf_dir)) == rows(catalog.QUERIES["rescale_delta_batch"](spark, sf_dir))


def test_late_packets(spark):
    packets = spark.createDataFrame([(1, 0, n, n, bytearray(b"x")) for n in (0, 1, 2)] + [(1, 0, 1, 1, bytearray(b"x"))], "file_id bigint, stream_index int, packet_index bigint, stream_packet bigint, payload binary")
    out = stream_queries.drive(spark, packets, running.stream_digest_running, "update", 1)
    assert [r.late_packet for r in out.where("late").collect()] == [1] and out.where("digest is not null").count() == 1


def test_gaps_are_bounded(spark):
    """Of more than three waiting packets the first is taken up and the missing ones are a gap; what comes for it then is late."""
    def rows(*numbers):
        return spark.createDataFrame([(1, 0, n, n, bytearray(b"%d" % n)) for n in numbers], "file_id bigint, stream_index int, packet_index bigint, stream_packet bigint, payload binary")

    driven = stream_queries.Driven(spark, lambda p: running.stream_digest_running(p, most_waiting=3), "update")
    driven.feed(rows(0, 3, 4, 6))
    driven.feed(rows(7))
    driven.feed(rows(1, 5))
    out = driven.rows().collect()
    assert [(r.gap_from, r.gap_to) for r in out if r.kind == "gap"] == [(1, 2)] and [r.late_packet for r in out if r.late] == [1]
    last = max((r for r in out if r.kind == "digest"), key=lambda r: r.batch)
    assert (last.packets, last.digest) == (6, f"{zlib.crc32(b'034567'):08x}")


def test_gaps_end_with_the_watermark(spark):
    """A packet that waits is taken up when the watermark is past its patience, over several runs from one checkpoint."""
    def rows(at, *numbers):
        df = spark.createDataFrame([(1, 0, n, n, bytearray(b"%d" % n)) for n in numbers], "file_id bigint, stream_index int, packet_index bigint, stream_packet bigint, payload binary")
        return df.select("*", F.timestamp_seconds(F.lit(at)).alias("arrived"))

    driven = stream_queries.Driven(spark, lambda p: running.stream_digest_running(p.withWatermark("arrived", "0 seconds"), patience=600), "update")
    driven.feed(rows(1000, 0, 2, 4))
    driven.feed(rows(1300, 0, 3))
    assert not driven.rows().where("kind = 'gap'").count()
    driven.feed(rows(9000, 5))
    driven.feed(rows(20_000, 6))
    out = driven.rows().collect()
    assert [(r.gap_from, r.gap_to) for r in out if r.kind == "gap"] == [(1, 1)] and [r.late_packet for r in out if r.late] == [0]
    last = max((r for r in out if r.kind == "digest"), key=lambda r: (r.batch, r.packets))
    assert (last.packets, last.digest) == (6, f"{zlib.crc32(b'023456'):08x}")


def test_crc_of_joined_pieces():
    for a, b in ((b"", b""), (b"", b"x"), (b"abc", b""), (b"abc", bytes(1000)), (bytes(5), b"\0\1")):
        assert running.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_arriving_files(spark, tmp_path):
    (tmp_path / "a.avi").write_bytes(b"RIFF0000AVI ")
    (tmp_path / "b.txt").write_bytes(b"text")
    out = tmp_path / "out"
    found = running.stream_media(spark, str(tmp_path / "*.*"))
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out)).awaitTermination()
    got = {r.path.rpartition("/")[2]: (r.format_name, r.probe_score) for r in spark.read.parquet(str(out)).collect()}
    assert got == {"a.avi": ("avi", 100), "b.txt": (None, 0)}


def test_updates_end_where_the_batch_does(spark, sf_dir):
    batch = catalog.QUERIES["stream_stats"](spark, sf_dir).where("packets > 0")
    assert rows(catalog.QUERIES["stream_stats_running"](spark, sf_dir)) == rows(batch)
    assert batch.select(F.sum("packets")).first()[0] > 0


def test_packets_that_come_together_cost_few_state_calls():
    """A hundred packets in reverse order, in one call: none is stored, and the order of folding is theirs."""
    import pandas as pd

    from cuemill.streaming.running import Delta, InOrder

    calls = []

    class State:
        def __init__(self):
            self.kept = {}

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "updateValue":
                    self.kept[args[0]] = args[1]
                return {"get": self.kept.get("head"), "exists": "head" in self.kept, "iterator": iter(list(self.kept.items())), "containsKey": args and args[0] in self.kept, "getValue": args and self.kept.get(args[0]), "keys": iter(list(self.kept))}.get(name)

            return call

    class Handle:
        getValueState = getMapState = lambda self, *args: State()

    fold = InOrder(Delta((1, 1000), (1, 48_000), (1, 90_000)), 1024, None)
    fold.init(Handle())
    rows = pd.DataFrame({"stream_packet": range(99, -1, -1), "packet_index": range(99, -1, -1), "pts": range(990, -1, -10), "duration": [480] * 100})
    (out,) = fold.handleInputRows((1, 0), iter([rows]), None)
    assert list(out["packet_index"]) == list(range(100)) and list(out["pts"]) == [900 * k for k in range(100)] and len(calls) <= 3
