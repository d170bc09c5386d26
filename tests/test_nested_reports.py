"""Reports over several sections against plain string building."""

import json
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from cuemill.operators import nested_reports as nr

FIELDS = {"packet": ["codec_type", "pts", "flags"], "stream": ["index", "codec_name"], "format": ["filename", "size"]}


@pytest.fixture(scope="module")
def tables(spark):
    tags = "array<struct<key:string,value:string>>"
    formats = spark.createDataFrame([(1, 'a "b" <c>', 10, [("title", "x=y|z"), ("é", "2")]), (2, "empty", 0, None), (3, "streams\nonly", 5, [])], f"file_id bigint, filename string, size bigint, tags {tags}")
    streams = spark.createDataFrame([(1, 1, 1, "raw", [("language", "eng")]), (1, 0, 0, None, None), (3, 0, 0, "pcm", None), (9, 0, 0, "gone", None)], f"file_id bigint, stream_index int, index bigint, codec_name string, tags {tags}")
    packets = spark.createDataFrame([(1, n, "video" if n % 2 else "audio", None if n == 3 else 10 * n, "K__") for n in range(12)], "file_id bigint, packet_index bigint, codec_type string, pts bigint, flags string")
    return formats, streams, packets


def whole(report):
    out = {}
    for r in sorted(report.collect(), key=lambda r: (r.file_id, r.rank, r.number)):
        out[r.file_id] = out.get(r.file_id, "") + r.piece
    return out


def test_json(tables):
    got = whole(nr.nested_report(*tables, FIELDS, "json"))
    assert set(got) == {1, 2, 3}
    one = json.loads(got[1])
    assert list(one) == ["packets", "streams", "format"] and len(one["packets"]) == 12
    assert one["packets"][4] == {"codec_type": "audio", "pts": 40, "flags": "K__"} and one["packets"][3] == {"codec_type": "video", "flags": "K__"}
    assert one["streams"] == [{"index": 0}, {"index": 1, "codec_name": "raw", "tags": {"language": "eng"}}]
    assert one["format"] == {"filename": 'a "b" <c>', "size": 10, "tags": {"title": "x=y|z", "é": "2"}}
    assert got[2] == '{\n  "packets": [\n    \n  ],\n  "streams": [\n    \n  ],\n  "format": {"filename": "empty", "size": 0}\n}\n'
    assert json.loads(got[3])["streams"] == [{"index": 0, "codec_name": "pcm"}]


def test_xml(tables):
    got = whole(nr.nested_report(*tables, FIELDS, "xml", "probe"))
    doc = minidom.parseString(got[1]).documentElement
    assert doc.tagName == "probe" and [n.tagName for n in doc.childNodes if n.nodeType == 1] == ["packets", "streams", "format"]
    assert [p.getAttribute("pts") for p in doc.getElementsByTagName("packet")] == [str(10 * n) if n != 3 else "" for n in range(12)]
    assert {t.getAttribute("key"): t.getAttribute("value") for t in doc.getElementsByTagName("format")[0].getElementsByTagName("tag")} == {"title": "x=y|z", "é": "2"}
    assert got[2] == '<?xml version="1.0" encoding="UTF-8"?>\n<probe>\n    <packets>\n    </packets>\n    <streams>\n    </streams>\n    <format filename="empty" size="0"/>\n</probe>\n'


def test_line_formats(tables):
    of = lambda fmt: whole(nr.nested_report(*tables, FIELDS, fmt))
    assert of("default")[3] == "[STREAM]\nindex=0\ncodec_name=pcm\n[/STREAM]\n[FORMAT]\nfilename=streams\nonly\nsize=5\n[/FORMAT]\n"
    assert of("default")[1].endswith("[STREAM]\nindex=1\ncodec_name=raw\nTAG:language=eng\n[/STREAM]\n[FORMAT]\nfilename=a \"b\" <c>\nsize=10\nTAG:title=x=y|z\nTAG:é=2\n[/FORMAT]\n")
    assert of("compact")[1].splitlines()[-3:] == ["stream|index=0", "stream|index=1|codec_name=raw|tag:language=eng", 'format|filename=a "b" <c>|size=10|tag:title=x\\=y\\|z|tag:é=2']
    assert of("csv")[1].splitlines()[11:] == ["packet,video,110,K__", "stream,0", "stream,1,raw,eng", 'format,"a ""b"" <c>",10,x=y|z,2']
    assert of("flat")[1].splitlines()[-6:] == ['streams.stream.1.codec_name="raw"', 'streams.stream.1.tags.language="eng"', 'format.filename="a \\"b\\" <c>"', "format.size=10", 'format.tags.title="x=y|z"', 'format.tags.é="2"']
    assert "packets.packet.11.pts=110\n" in of("flat")[1]
    ini = of("ini")
    assert ini[2] == "# report output\n\n[format]\nfilename=empty\nsize=0\n"
    assert ini[1].startswith("# report output\n\n[packets.packet.0]\ncodec_type=audio\npts=0\nflags=K__\n\n[packets.packet.1]\n")
    assert ini[1].endswith("[streams.stream.1]\nindex=1\ncodec_name=raw\n\n[streams.stream.1.tags]\nlanguage=eng\n\n[format]\nfilename=a \"b\" <c>\nsize=10\n\n[format.tags]\ntitle=x=y|z\né=2\n")
    with pytest.raises(ValueError):
        nr.nested_report(*tables, FIELDS, "yaml")


@pytest.mark.parametrize("fmt", ["json", "ini"])
def test_written(spark, tables, tmp_path, fmt):
    """One file per report, and all reports as lines of one dataset, in order."""
    report = nr.nested_report(*tables, FIELDS, fmt)
    want = whole(report)
    files = {r.file_id: open(r.path, encoding="utf-8").read() for r in nr.write_files(report, f"file://{tmp_path}/files", fmt).collect()}
    assert files == want
    nr.write_lines(report, f"file://{tmp_path}/lines")
    parts = sorted(p for p in (tmp_path / "lines").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text(encoding="utf-8") for p in parts) == "".join(want[k] for k in sorted(want))


def test_a_report_of_many_packets_is_spread(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packets = spark.range(300_000).select(F.lit(1).alias("file_id"), F.col("id").alias("packet_index"), F.col("id").alias("pts"))
        formats = spark.createDataFrame([(1, "x")], "file_id int, filename string")
        streams = spark.createDataFrame([(1, 0)], "file_id int, stream_index int")
        report = nr.nested_report(formats, streams, packets, {"packet": ["pts"], "stream": ["stream_index"], "format": ["filename"]}, "json")
        tasks = report.orderBy("file_id", "rank", "number").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(r["count"] for r in tasks) == 300_008 and len(tasks) >= 4 and max(r["count"] for r in tasks) < 200_000


def test_all_formats_in_one_pass(spark, tables, tmp_path):
    """Rows are numbered and dealt once, whatever the formats; each format has a folder of its own."""
    report = nr.nested_reports(*tables, FIELDS, nr.FORMATS)
    done = nr.write_files(report, f"file://{tmp_path}")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning(kind#") == 1
    got = {(r.path.split("/")[-3], r.file_id): open(r.path, encoding="utf-8").read() for r in done.collect()}
    assert got == {(fmt, k): text for fmt in nr.FORMATS for k, text in whole(nr.nested_report(*tables, FIELDS, fmt)).items()}
