"""Column functions against literal values."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cuemill.functions import digests, tags, text
from cuemill.functions import timebase as tb
from cuemill.operators import dims, fingerprint, probe
from cuemill.operators import packets as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def big(v):
    return F.lit(v).cast("bigint")


@pytest.mark.parametrize(
    "v,b,c,mode,expected",
    [(3, 1, 2, "near", 2), (1, 1, 3, "zero", 0), (1, 1, 3, "inf", 1), (1, 1, 3, "up", 1), (-1, 1, 3, "inf", -1), (-1, 1, 3, "up", 0), (-1, 1, 3, "down", -1), (1, 1, 2, "near", 1), (-1, 1, 2, "near", -1),
     (tb.MAX, tb.MAX, tb.MAX, "near", tb.MAX), (tb.MAX, 2, 1, "near", None), (5, -1, 1, "near", None), (5, 1, 0, "near", None), (tb.MIN, 1, 1, "down", tb.MIN)],
)
def test_rescale(spark, v, b, c, mode, expected):
    assert one(spark, tb.rescale(big(v), b, c, mode)) == expected
    if expected is not None:
        assert tb.div_round(v * b, c, mode) == expected


def test_rescale_q_and_comparisons(spark):
    assert one(spark, tb.rescale_q(big(90000), (1, 90000), (1, 1000))) == 1000
    assert one(spark, tb.rescale_q(big(3003), (1, 90000), (1, 1000))) == 33
    assert one(spark, tb.rescale_q(big(tb.MAX), (2, 1), (1, 1), pass_minmax=True)) == tb.MAX
    assert one(spark, tb.rescale_q(big(1), (1, 0), (1, 1))) is None
    assert one(spark, tb.compare_ts(big(1000), (1, 1000), big(1), (1, 1))) == 0
    assert one(spark, tb.compare_ts(big(3003), (1, 90000), big(33), (1, 1000))) == 1
    assert one(spark, tb.compare_ts(big(-500), (1, 1000), big(0), (1, 1))) == -1
    for a, b, m, e in ((0x11, 0x02, 0x10, -1), (0x11, 0x02, 0x20, 15), (0x02, 0x11, 0x10, 1), (-1, 0, 16, -1), (1, 0, 12, None)):
        assert one(spark, tb.compare_mod(big(a), big(b), m)) == e


def test_rationals(spark):
    half = F.struct(F.lit(-2).alias("num"), F.lit(-4).alias("den"))
    assert tuple(one(spark, tb.rational(F.lit(-2), F.lit(-4)))) == (1, 2)
    assert tuple(one(spark, tb.add(half, (1, 3)))) == (5, 6) and tuple(one(spark, tb.subtract(half, (1, 3)))) == (1, 6)
    assert tuple(one(spark, tb.multiply(half, (2, 3)))) == (1, 3) and tuple(one(spark, tb.divide(half, (1, 4)))) == (2, 1)
    assert tuple(one(spark, tb.negate((1, 2)))) == (-1, 2) and tuple(one(spark, tb.reciprocal((-1, 2)))) == (-2, 1)
    assert one(spark, tb.rational(F.lit(1), F.lit(0))) is None and one(spark, tb.divide((1, 2), (0, 1))) is None
    assert one(spark, tb.multiply((2147483647, 1), (2, 1))) is None
    for a, b, e in (((1, 2), (1, 3), 1), ((1, 0), (5, 1), 1), ((1, 0), (-1, 0), 1), ((0, 0), (1, 0), None), ((1, 2), (2, 4), 0)):
        assert one(spark, tb.compare(a, b)) == e
    assert one(spark, tb.reduce_ratio(big(1920 * 4), big(1080 * 4), ":")) == "16:9"
    assert tuple(one(spark, tb.gcd_with_limit((1, 4), (1, 6), 100, (7, 9)))) == (1, 12)
    assert tuple(one(spark, tb.gcd_with_limit((1, 4), (1, 6), 12, (7, 9)))) == (7, 9)


def test_bounded_fractions():
    assert tb.bounded(30000, 1001, 2147483647) == (30000, 1001)
    assert tb.bounded(314159265, 100000000, 1000) == (355, 113)
    assert tb.from_double(float("nan"), 100) == (0, 0) and tb.from_double(-1e20, 100) == (-1, 0) and tb.from_double(0.0, 9) == (0, 1)
    assert tb.from_double(29.97002997002997, 100_000) == (30000, 1001) and tb.from_double(-0.5, 9) == (-1, 2)
    for n, d, most in ((355, 113, 50), (1000001, 3, 1000), (7, 1000003, 100), (12345, 67891, 97)):
        p, q = tb.bounded(n, d, most)
        best = min((abs(n / d - a / b), b) for b in range(1, most + 1) for a in (min(most, n * b // d), min(most, n * b // d + 1)))
        assert abs(n / d - p / q) <= best[0] + 1e-12 or n > d * most


def test_times_and_rates(spark):
    assert one(spark, tb.format_time(big(-1001), (1, 30000))) == "-0.033367"
    assert one(spark, tb.format_time(big(90000), (1, 90000))) == "1.000000"
    assert one(spark, tb.format_time(F.lit(None).cast("bigint"), (1, 10))) is None
    assert tuple(one(spark, tb.rate_from_text(F.lit("30000/1001")))) == (30000, 1001)
    assert tuple(one(spark, tb.rate_from_text(F.lit("50:2"), (":",)))) == (25, 1)
    for bad in ("0", "1/0", "x", "-5", "1/2/3", ""):
        assert one(spark, tb.rate_from_text(F.lit(bad))) is None
    assert one(spark, probe.nearest_rate((29, 1), [(24, 1), (34, 1), (30, 1)])) == 2
    assert one(spark, probe.nearest_rate((29, 1), [(28, 1), (30, 1)])) == 0


def test_drift_free_steps():
    bases = ((1, 1000), (1, 48000), (1, 90000))
    assert tb.delta_step(100, 1024, None, *bases) == (9000, 5824)
    assert tb.delta_step(1000, 1024, 48010, *bases)[1] == 49034
    assert tb.delta_step(1000, 1024, 48050, *bases)[1] == 49048
    assert tb.delta_step(1000, 1024, 47000, *bases)[1] == 49024
    ts, seen = 0, []
    for _ in range(10):
        ts = tb.stable_step(ts, (1, 1000), (1, 30))
        seen.append(ts)
    assert seen == [33, 67, 100, 133, 167, 200, 233, 267, 300, 333]


VECTORS = {
    "adler32": {b"": "00000001", b"123456789": "091e01de", b"Wikipedia": "11e60398"},
    "CRC32": {b"": "00000000", b"123456789": "cbf43926", b"The quick brown fox jumps over the lazy dog": "414fa339"},
    "murmur3": {b"": "f172e5acc891f8bf6981a829b5a83a3d", b"abc": "24f8c0b6239d906515c11aef9def41d2"},
    "RIPEMD128": {b"": "cdf26213a150dc3ecb610f18f6b38b46", b"abc": "c14a12199c66e4ba84636b0f69144c77"},
    "RIPEMD256": {b"": "02ba4c4e5f8ecd1877fc52d64d30e37a2d9774fb1e5d026380ae0168e3c5522d"},
    "RIPEMD320": {b"abc": "de4c01b3054f8930a79d09ae738e92301e5a17085beffdc1b8d116713e74f82fa942d64cdbc4682d"},
}


@pytest.mark.parametrize("name", digests.ALGORITHMS)
def test_digests(spark, name):
    python = {"SHA160": "sha1"}.get(name, name.lower().replace("/", "_"))
    expected = VECTORS.get(name) or {d: hashlib.new(python, d).hexdigest() for d in (b"", b"abc", b"x" * 1000)}
    df = spark.createDataFrame([(d,) for d in expected], "d binary").select("d", digests.hash_hex(F.col("d"), name.lower()).alias("h"))
    assert {bytes(r.d): r.h for r in df.collect()} == expected
    assert all(digests.digest_of(d, name) == h for d, h in expected.items())


def test_digest_names_and_sql(spark):
    assert digests.algorithm("sha-1") == "SHA160" and digests.algorithm("SHA512_224") == "SHA512/224" and digests.muxer_name("adler-32") == "ADLER32"
    with pytest.raises(ValueError):
        digests.algorithm("sha3")
    digests.register(spark)
    assert spark.sql("select hash_adler32(cast('Wikipedia' as binary)) x").first().x == "11e60398"


def test_checksums_of_parts(spark):
    parts = [b"hello", b"", b"world" * 20, b"!"]
    rows = spark.createDataFrame([(1, i, p, len(p)) for i, p in enumerate(parts)], "file_id int, packet_index int, payload binary, size bigint")
    a, b = fingerprint.adler_parts(F.col("payload"))
    whole = b"".join(parts)
    merged = rows.select("file_id", "packet_index", "size", a.alias("a"), b.alias("b"))
    assert fingerprint.adler32_merge(merged, ["file_id"]).first().digest == f"{zlib.adler32(whole):08x}"
    assert fingerprint.adler32_merge(merged, ["file_id"], 0).first().digest == f"{zlib.adler32(whole, 0):08x}"
    crc = rows.select("file_id", "packet_index", "size", F.crc32("payload").alias("crc"))
    assert fingerprint.crc32_merge(crc, ["file_id"]).first().digest == f"{zlib.crc32(whole):08x}"


def test_framecrc_line(spark):
    row = spark.createDataFrame([(1, 0, 2, 10, 8, 2, 3, bytearray(b"abc")), (1, 1, 0, None, None, 0, 0, bytearray(b""))], "file_id int, packet_index int, stream_index int, pts bigint, dts bigint, duration bigint, size bigint, payload binary")
    lines = [r.line for r in fingerprint.framecrc_lines(fingerprint.framecrc(row)).orderBy("packet_index").collect()]
    assert lines == ["2,          8,         10,        2,        3, 0x024a0126", "0,        N/A,        N/A,        0,        0, 0x00000000"]


def test_stream_digests_and_stats(spark):
    rows = [(1, 0, 2, "a"), (1, 1, 0, "b"), (1, 2, 2, "c"), (1, 3, 0, "d")]
    packets = spark.createDataFrame([(f, i, s, p.encode(), 1, i, None if i == 2 else i, 5) for f, i, s, p in rows], "file_id int, packet_index int, stream_index int, payload binary, size bigint, pts bigint, dts bigint, duration bigint")
    got = {r.stream_index: r.digest for r in fingerprint.streamhash(packets).collect()}
    assert got == {0: hashlib.sha256(b"bd").hexdigest(), 2: hashlib.sha256(b"ac").hexdigest()}
    for name in ("crc32", "adler32"):
        assert fingerprint.filehash(packets, name).first().digest == digests.digest_of(b"abcd", name)
    stats = {r.stream_index: r for r in P.stream_stats(packets).collect()}
    assert stats[1].packets == 0 and stats[1].last_pts is None and (stats[2].last_pts, stats[2].last_dts) == (2, None)
    assert one(spark, P.flags_text(F.lit(7))) == "KDC" and one(spark, P.flags_text(F.lit(4))) == "_D_"


def test_tags(spark):
    def listed(column):
        return [tuple(t) for t in one(spark, column)]

    base = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("Title", "First"), ("a", "1"), ("A", "2"))])
    assert listed(tags.tags_set(base, "title", "Second"))[0] == ("title", "Second")
    assert listed(tags.tags_set(base, "TITLE", "x", "keep"))[0] == ("Title", "First")
    assert listed(tags.tags_set(base, "TITLE", "x", "append"))[0] == ("TITLE", "Firstx")
    assert len(listed(tags.tags_set(base, "a", "1", "dedup"))) == 3 and len(listed(tags.tags_set(base, "a", "9", "dedup"))) == 4
    assert listed(tags.tags_set(base, "A", "9", exact=True))[2] == ("A", "9") and listed(tags.tags_set(base, "new", "9"))[-1] == ("new", "9")
    assert one(spark, tags.tags_set(base, "", "x")) is None and one(spark, tags.tags_set(base, "a\0", "x")) is None
    assert one(spark, tags.tags_get(base, "A")) == "1" and one(spark, tags.tags_get(base, "A", True)) == "2" and one(spark, tags.tags_get(base, "zz")) is None
    assert len(listed(tags.tags_remove(base, "a"))) == 2 and len(listed(tags.tags_remove(base, "zz"))) == 3
    assert one(spark, tags.format_pairs(F.array(F.struct(F.lit("k:e").alias("key"), F.lit("a=b\\").alias("value"))))) == r"k\:e=a\=b\\"
    assert tags.split_pairs(r"k\:e=a\=b\\:x=", "=", ":") == ([("k:e", "a=b\\"), ("x", "")], None)
    for broken in ("a=1:b", "a=1:=2", "a=1:b=x\\"):
        pairs, error = tags.split_pairs(broken, "=", ":")
        assert pairs == [("a", "1")] and error
    parsed = one(spark, tags.parse_pairs(F.lit("a=1:A=2:b")))
    assert [tuple(t) for t in parsed.tags] == [("A", "2")] and parsed.error
    assert one(spark, tags.language_code(F.lit(5575))) == "eng" and one(spark, tags.language_code(F.lit(0))) is None


def test_escapes_and_dump(spark):
    raw = "a\\b|c=d:e\n\r\t\"'<&>,\x01"
    assert one(spark, text.escape_compact(F.lit(raw))) == "a\\\\b\\|c\\=d:e\\n\\r\t\"'<&>,\x01"
    assert one(spark, text.escape_ini(F.lit(raw))) == "a\\\\b|c=d\\:e\\n\\r\t\"'<&>,\x01"
    assert one(spark, text.escape_xml(F.lit("<a b='c' d=\"e\">&\r\n"))) == "&lt;a b=&apos;c&apos; d=&quot;e&quot;&gt;&amp;&#13;\n"
    assert one(spark, text.escape_csv(F.lit('a,"b"'))) == '"a,""b"""' and one(spark, text.escape_csv(F.lit("ab"))) == "ab"
    assert one(spark, text.escape_json(F.lit(raw))).endswith("\\u0001") and '\\"' in one(spark, text.escape_json(F.lit(raw)))
    assert one(spark, text.hex_dump(F.lit(bytearray(b"0123456789abcdef\x00z")))) == "\n00000000: 3031 3233 3435 3637 3839 6162 6364 6566  0123456789abcdef\n00000010: 007a" + " " * 35 + "  .z\n"
    assert one(spark, text.hex_dump(F.lit(bytearray(b"")))) == "\n"


def test_probe(spark):
    files = spark.createDataFrame([(1, "song.mp3", bytearray(b"RIFF0000WAVE"), "x/y"), (2, "a.DAT", bytearray(b""), None), (3, "noext", bytearray(b"?"), "Audio/One"), (4, "dir.dat/none", bytearray(b""), None)], "file_id int, path string, content binary, mime string")
    registry = [probe.Descriptor("one", ("dat",), ("audio/one",)), probe.Descriptor("wav", ("wav",), (), ((8, b"WAVE"),)), probe.Descriptor("two", ("dat",))]
    got = {r.file_id: (r.format_name, r.probe_score) for r in probe.probe_formats(files, registry, "mime").collect()}
    assert got == {1: ("wav", 100), 2: ("one", 50), 3: ("one", 75), 4: (None, 0)}
    with pytest.raises(ValueError):
        probe.Descriptor("")
    assert probe.parse_entries("stream=index,id:format:stream=width:format=size") == {"stream": ["index", "id", "width"], "format": None}
    with pytest.raises(ValueError):
        probe.parse_entries("nothing=1")
    forced = probe.with_stream_params(files, "wav", sample_rate=1).select("file_id", "error").collect()
    assert {r.file_id for r in forced if r.error is None} == {1}
    with pytest.raises(ValueError):
        probe.with_stream_params(files, "rawvideo", width=2)


def test_names(spark):
    assert one(spark, probe.codec_tag_hex(F.lit("avc1"))) == "0x31637661" and one(spark, probe.codec_tag_hex(F.lit("\0\0\0\0"))) == "0x0000" and one(spark, probe.codec_tag_hex(F.lit("abc"))) is None
    none = F.lit(None).cast("string")
    assert one(spark, probe.codec_type(none, F.lit("audio"), none, none)) == "audio"
    assert one(spark, probe.codec_type(none, none, F.lit(1), none)) == "video" and one(spark, probe.codec_type(none, none, F.lit(1), none, True)) == "unknown"
    assert len(dims.CHANNEL_LAYOUTS) == 40 and {f.name: f.bytes for f in dims.SAMPLE_FORMATS}["s64p"] == 8


def test_sql_of_nearest_fractions_is_exact():
    """Doubles that lie midway between two fractions: the SQL breaks the tie as the query does, by denominator, then numerator."""
    import duckdb

    from cuemill.jobs import packet_queries

    prices = [97 * k + 48.5 for k in (1, 38, 500, 700, 999, 1000)] + [97 * (a / b + c / d) / 2 for a, b, c, d in ((1, 10, 3, 29), (355, 113, 22, 7), (1, 999, 1, 998), (700, 3, 467, 2))] + [0.0, 0.01, 1234.56, 499999.99]
    con = duckdb.connect()
    con.execute("create table orders (o_orderkey bigint, o_totalprice double)")
    con.executemany("insert into orders values (?, ?)", list(enumerate(prices)))
    got = {k: (p, q) for k, p, q in con.sql(packet_queries._NEAREST).fetchall()}
    assert got == {k: tb.from_double(v / 97, 1000) for k, v in enumerate(prices)} and got[3] == (700, 1)


def test_sql_of_fractions_is_null_beyond_32_bits(spark, tmp_path):
    import duckdb

    from cuemill.jobs import packet_queries
    from cuemill.jobs.registry import ORACLE_SQL

    con = duckdb.connect()
    con.execute("create table lineitem as select 1::bigint l_orderkey, n::bigint l_linenumber, p::bigint l_partkey, s::bigint l_suppkey from (values (1, 1200000, 60000), (2, 7, 9), (3, 59999, 35789), (4, 60000, 35790), (5, 2147483646, 0)) t(n, p, s)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    rows = packet_queries.rational_arithmetic(spark, str(tmp_path))
    want = con.sql(f"select {', '.join(rows.columns)} from ({ORACLE_SQL['rational_arithmetic']})").fetchall()
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, want)) and sum(r[4] is None for r in want) > 0
