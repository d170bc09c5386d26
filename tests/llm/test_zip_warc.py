import hashlib
import io
import zipfile

import duckdb
import pytest

from cuemill.llm import zip_warc
from cuemill.llm.queries import QUERIES
from cuemill.llm.sql import ORACLES
from cuemill.llm.storage import new_folder


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = QUERIES["op9_zip_warc"](spark, sf_dir).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(ORACLES["op9_zip_warc"]).select(", ".join(columns)).fetchall()))


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.read_bytes += len(data)
        return data


@pytest.mark.parametrize("wide", [False, True])
def test_directories_like_zipfile(wide):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for k in range(70_000 if wide else 20):  # more than 65535 members need ZIP64
            with z.open(zipfile.ZipInfo(f"m{k}é"), "w", force_zip64=k % 2 == 0) as m:
                m.write(b"x" * (k % 7))
        z.comment = b"a comment"
    file = Counted(raw.getvalue())
    members = zip_warc.central_directory(file, len(raw.getvalue()))
    with zipfile.ZipFile(raw) as z:
        assert {n: (m["size"], m["local"]) for n, m in members.items()} == {i.filename: (i.file_size, i.header_offset) for i in z.infolist()}
        for name in ("m3é", "m6é"):
            at = zip_warc.stored_at(file, members[name])
            assert raw.getvalue()[at : at + members[name]["size"]] == z.read(name)


def test_zip64_sizes_and_offsets():
    """All-ones fields take their values from the ZIP64 extra field, in order."""
    import struct

    extra = struct.pack("<HHQQQ", 1, 24, 5 << 32, 5 << 32, 7 << 32)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 9, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    record = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, len(entry), 1)
    raw = entry + record + locator + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    m = zip_warc.central_directory(io.BytesIO(raw), len(raw))["a"]
    assert (m["size"], m["packed"], m["local"]) == (5 << 32, 5 << 32, 7 << 32)


@pytest.mark.parametrize("raw", [b"", b"PK\5\6", b"PK\5\6" + b"\xff" * 18, b"junk" * 100])
def test_broken_files_raise(raw):
    with pytest.raises(ValueError):
        zip_warc.central_directory(io.BytesIO(raw), len(raw))


def test_compressed_members_are_refused():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    with pytest.raises(ValueError):
        zip_warc.stored_at(raw, zip_warc.central_directory(raw, len(raw.getvalue()))["a"])


def test_record_round_trip():
    import gzip

    raw = zip_warc.record(5, "http://x/\r\nEvil: 1", b"body\r\n\r\nmore", "d", "response", None)
    got = zip_warc.parse(gzip.decompress(gzip.compress(raw)))
    assert got == {"page_id": 5, "payload_bytes": 12, "payload_digest": hashlib.sha256(b"body\r\n\r\nmore").hexdigest(), "record_type": "response", "refers_to": None}
    assert b"\r\nEvil" not in raw
    got = zip_warc.parse(zip_warc.record(6, None, b"y" * 300, "abc", "revisit", 5))
    assert got == {"page_id": 6, "payload_bytes": 300, "payload_digest": "abc", "record_type": "revisit", "refers_to": 5}


def test_revisits_and_packages(spark):
    long, short = "é" * 60, "s" * 99
    rows = [(3, "http://a/", long), (1, None, long), (2, "http://b/", long), (4, "u", short), (5, "u", short), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "twice" * 30), (8, "u", "twice" * 30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    packages = zip_warc.write_packages(zip_warc.planned(pages), new_folder(spark, "t"), most_records=3)
    assert packages.count() >= 4 and packages.agg({"records": "sum"}).first()[0] == len(rows)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in zip_warc.read_records(zip_warc.read_index(packages)).collect()}
    assert got == {(1, "response", None, 120), (2, "revisit", 1, 120), (3, "revisit", 1, 120), (None, "revisit", 1, 120), (4, "response", None, 99), (5, "response", None, 99), (6, "response", None, 0), (7, "response", None, 0), (8, "response", None, 150)}
    assert zip_warc.round_trip(pages.limit(0)).count() == 0


def test_clashing_columns_large_pages_and_even_reading(spark):
    rows = [(i, "http://x/", "é" * (3_000_000 if i == 1 else 200) + str(i % 7), "clash", i, "response") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, first bigint, record_type string").repartition(3)
    packages = zip_warc.write_packages(zip_warc.planned(pages), new_folder(spark, "t"))
    assert zip_warc.tasks_for(packages) == -(-packages.agg({"bytes": "sum"}).first()[0] // zip_warc.TASK_BYTES)
    got = zip_warc.read_records(zip_warc.read_index(packages), 5)
    assert got.rdd.getNumPartitions() == 5
    by_id = {r.page_id: r for r in got.collect()}
    assert len(by_id) == 300 and by_id[1].payload_bytes == 6_000_001 and by_id[1].record_type == "response"
    assert by_id[8].refers_to is None and by_id[15].refers_to == 8 and by_id[15].record_type == "revisit"
