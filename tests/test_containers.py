"""Containers: literal bytes, round trips, and damaged input."""

import struct

import pytest
from pyspark.sql import functions as F

from cuemill.operators import decode, dims, mux, reports
from cuemill.operators import sample_tables as S
from cuemill.sources import boxes, containers, media, mov_writer


def files(spark, contents):
    return spark.createDataFrame([(i, f"f{i}", bytearray(c), len(c)) for i, c in enumerate(contents)], "file_id bigint, path string, content binary, length bigint")


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def wav(*parts):
    return b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"WAVE" + b"".join(parts)


def fmt(channels=2, rate=48000, tag=1, bits=16, align=None, extra=b""):
    align = 2 * channels if align is None else align
    return chunk(b"fmt ", struct.pack("<HHIIHH", tag, channels, rate, rate * align, align, bits) + extra)


def test_wav(spark):
    ext = struct.pack("<HHI", 22, 16, 3) + boxes.PCM_GUID
    contents = [
        wav(fmt(), fmt(1), chunk(b"data", b"old."), chunk(b"odd ", b"x"), chunk(b"data", b"abcdefgh")),
        wav(fmt(), chunk(b"data", b"")),
        wav(fmt(tag=0xFFFE, extra=ext), chunk(b"data", b"abcde")),
        wav(fmt(bits=8), chunk(b"data", b"ab")),
        wav(fmt(align=3), chunk(b"data", b"ab")),
        wav(chunk(b"data", b"ab")),
        wav(fmt(tag=3), chunk(b"data", b"ab")),
        b"nonsense",
    ]
    good, bad = media.split_errors(containers.wav_packets(files(spark, contents)), "wav")
    assert {r.file_id: (bytes(r.payload), r.duration, r.pts) for r in good.collect()} == {0: (b"abcdefgh", 2, 0), 2: (b"abcde", 1, 0)}
    assert {r.file_id: r.error_kind for r in bad.collect()} == {3: "InvalidData", 4: "InvalidData", 5: "InvalidData", 6: "Unsupported", 7: "EndOfFile"}
    checked = {r.file_id: r.problem for r in containers.validate_wav(containers.wav_headers(files(spark, contents[:5]))).collect()}
    assert checked[0] is None and "bits" in checked[3] and "align" in checked[4]


def test_avi(spark):
    frames = [bytes(range(12)), bytes(range(12, 24))]
    content = mux.avi_file(frames, 2, 2, (25, 1))
    info = boxes.avi(content)
    assert info["header"]["microseconds_per_frame"] == 40000 and info["streams"][0]["length"] == 2
    assert [p["payload"] for p in info["packets"]] == [f[:6] + b"\0\0" + f[6:] + b"\0\0" for f in frames]
    assert all(content[p["pos"] : p["pos"] + 16] == p["payload"] for p in info["packets"])
    got = containers.avi_packets(files(spark, [content, content.replace(b"00dc", b"07dc"), content.replace(b"vids", b"auds")]))
    assert {(r.file_id, r.pts) for r in got.where("error is null").collect()} == {(0, 0), (0, 1)}
    assert {r.file_id: r.error_kind for r in got.where("error is not null").collect()} == {1: "InvalidData", 2: "Unsupported"}
    assert containers.validate_avi(containers.avi_streams(files(spark, [content]))).count() == 0


def test_avi_nested_and_repeated_lists():
    inner = chunk(b"LIST", b"rec " + chunk(b"00db", b"one!") + chunk(b"JUNK", b""))
    base = mux.avi_file([b"\0" * 12], 2, 2, (25, 1))
    header_end = base.index(b"LIST", 40)
    while base[header_end + 8 : header_end + 12] != b"movi":
        header_end = base.index(b"LIST", header_end + 4)
    body = base[12:header_end] + base[header_end:] + chunk(b"LIST", b"movi" + inner)
    content = b"RIFF" + struct.pack("<I", 4 + len(body)) + b"AVI " + body
    assert [p["payload"] for p in boxes.avi(content)["packets"]] == [b"one!"]


def test_y4m():
    head = b"YUV4MPEG2 W2 H2 F25:1 Ip A1:1 C420jpeg XCOLORRANGE=FULL\n"
    info = boxes.y4m(head + b"\n \nFRAME\nabcdefFRAME Ixyz\nghijklFRAME\nabc")
    assert [f for _, f in info["frames"]] == [b"abcdef", b"ghijkl"] and info["sar"] == "1:1" and info["color_range"] == "pc"
    assert boxes.y4m(head)["frames"] == [] and boxes.y4m(head + b"other\n")["frames"] == []
    for broken, kind in ((b"", "EndOfFile"), (b"YUV\n", "InvalidData"), (b"YUV4MPEG2 W2 H3 F25:1\n", "Unsupported"), (b"YUV4MPEG2 W2 H2\n", "InvalidData"), (head + b"FRAME\nabcdefjunk\n", "InvalidData"), (b"YUV4MPEG2 W2 H2 F1:1 It\n", "Unsupported")):
        with pytest.raises(boxes.Bad) as e:
            boxes.y4m(broken)
        assert e.value.kind == kind
    assert boxes.y4m(mux.y4m_header(2, 2, (25, 1), color_range="tv") + b"FRAME\nabcdef")["color_range"] == "tv"


def test_image_sequences(spark):
    def run(numbers, start):
        df = spark.createDataFrame([(f"d/img{n:03d}.png", bytearray(str(n).encode()), 1) for n in numbers], "path string, content binary, length bigint")
        packets, bad = media.image_sequence(df, "d/img%03d.png", start)
        return [(r.pts, bytes(r.payload)) for r in packets.orderBy("pts").collect()], bad.count()

    assert run([0, 2], 0) == ([(0, b"0")], 0) and run([0, 2], 1) == ([(0, b"2")], 0)
    assert run([5], 1) == ([(0, b"5")], 0) and run([10], 1) == ([], 1)
    assert run([3, 1, 2], 0)[0] == [(0, b"1"), (1, b"2"), (2, b"3")]
    assert run([1, 1, 2], 0)[1] == 1
    number = lambda p, path: spark.range(1).select(media.frame_number(F.lit(path), p).alias("n")).first().n
    assert number("a%03d.x", "a0012.x") == 12 and number("a%03d.x", "a12.x") is None and number("a%d%%.x", "a7%.x") == 7 and number("a.x", "a.x") == 0
    assert spark.range(1).select(media.number_path(F.lit(12345), "a%03d.x").alias("p")).first().p == "a12345.x"
    for bad in ("%d%d", "%s", "%0d", "x%"):
        with pytest.raises(ValueError):
            media.split_pattern(bad)


def test_sample_timeline(spark):
    key = "file_id int, track int, ord int, count bigint, value bigint"
    runs = lambda rows: spark.createDataFrame([(1, 0, i, n, v) for i, (n, v) in enumerate(rows)], key)
    sizes, durations, ctts = runs([(3, 2)]), runs([(1, 10), (1, 20), (1, 30)]), runs([(2, 5), (1, 7)])
    stsc = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 0, 1, 2, 1)], "file_id int, track int, ord int, first_chunk bigint, samples_per_chunk bigint")
    offsets = spark.createDataFrame([(1, 0, 1, 100), (1, 0, 2, 200)], "file_id int, track int, chunk bigint, chunk_offset bigint")
    chunks = S.chunk_runs(stsc, spark.createDataFrame([(1, 0, 2)], "file_id int, track int, chunk_count bigint"))
    rows = S.zip_samples(S.expand_runs(sizes, "size"), S.expand_runs(durations, "duration"), S.expand_runs(ctts, "ctts"), spark.createDataFrame([(1, 0, 0)], "file_id int, track int, sample bigint"))
    placed = S.place_samples(rows.join(S.samples_in_chunks(chunks), ["file_id", "track", "sample"]).join(offsets, ["file_id", "track", "chunk"]))
    got = [(r.dts, r.pts, r.pos, r.flags) for r in S.timeline(placed).orderBy("sample").collect()]
    assert got == [(0, 5, 100, 1), (10, 15, 102, 0), (30, 37, 200, 0)]
    ranges = spark.createDataFrame([(1, 100, 104)], "file_id int, start bigint, end bigint")
    assert S.inside_ranges(placed, ranges).count() == 2 and S.inside_ranges(placed, ranges, False).count() == 1
    assert S.validate(durations, ctts, sizes, stsc).count() == 0
    assert S.validate(runs([(2, 1)]), ctts, sizes, stsc).first().error.startswith("duration")
    assert S.validate(durations, runs([(9, 1)]), sizes, stsc).first().error.startswith("offset")
    hostile = runs([(1 << 40, 1)])
    assert S.expand_runs(hostile, "x").count() == 0 and S.oversize(hostile).count() == 1


def test_mov(spark):
    aac = mov_writer.movie([b"aa", b"bbb"], [1024, 882], 48000, b"soun", mov_writer.audio_entry(b"mp4a", 2, 16, 48000), media_time=1024, wide=True)
    neg = mov_writer.movie([b"a", b"b"], [10, 10], ctts=[-2, 0], sync=[2], per_chunk=1)
    got = containers.mov_packets(files(spark, [aac, neg])).orderBy("file_id", "sample").collect()
    assert [(r.dts, r.pts, r.flags, r.skip_samples) for r in got] == [(-1024, -1024, 5, 1024), (0, 0, 1, None), (0, -2, 0, None), (10, 10, 1, None)]
    assert [aac[r.pos : r.pos + r.size] for r in got[:2]] == [b"aa", b"bbb"]
    tracks = {r.file_id: r for r in containers.mov_tracks(files(spark, [aac, neg])).collect()}
    assert (tracks[0].kind, tracks[0].channels, tracks[0].sample_rate, tracks[0].media_time) == ("audio", 2, 48000, 1024)
    assert (tracks[1].kind, tracks[1].width, tracks[1].nb_frames, tracks[1].duration_ts) == ("video", 2, 2, 20)


def test_sample_entries():
    avcc = mov_writer.box(b"avcC", bytes([1, 100, 0, 31, 0xFF, 0xE0, 0]))
    colr = mov_writer.box(b"colr", b"nclx", struct.pack(">HHHB", 1, 13, 6, 0x80))
    entry = mov_writer.video_entry(b"avc1", 640, 480, avcc, mov_writer.box(b"pasp", struct.pack(">II", 4, 3)), colr)
    got = boxes.sample_entry(b"\0" * 4 + struct.pack(">I", 1) + entry)
    assert {k: got[k] for k in ("profile", "level", "nal_length_size", "h_spacing", "primaries", "transfer", "matrix", "full_range")} == {"profile": 100, "level": 31, "nal_length_size": 4, "h_spacing": 4, "primaries": 1, "transfer": 13, "matrix": 6, "full_range": True}


def test_mov_tags_and_art(spark):
    ilst = (
        mov_writer.data_atom(b"\xa9nam", 1, "Tïtle".encode()) + mov_writer.data_atom(b"\xa9ART", 2, b"\xff\xfe" + "Ab".encode("utf-16-le"))
        + mov_writer.data_atom(b"trkn", 0, bytes([0, 0, 0, 3, 0, 0])) + mov_writer.data_atom(b"gnre", 0, bytes([0, 18])) + mov_writer.data_atom(b"tvsn", 21, bytes([0, 0, 0, 5]))
        + mov_writer.freeform("com.x", "mood", "calm") + mov_writer.freeform("com.x", "cdec", "hidden") + mov_writer.data_atom(b"covr", 13, boxes.PNG + b"....") + mov_writer.data_atom(b"covr", 27, b"BM")
    )
    movie = mov_writer.movie([b"x"], [1], language=5575, handler_name="h", ilst=ilst)
    tags = [(r.owner, r.key, r.value) for r in containers.mov_tags(files(spark, [movie])).orderBy("ord").collect()]
    assert tags == [(None, "title", "Tïtle"), (None, "artist", "Ab"), (None, "track", "3"), (None, "genre", "Rock"), (None, "season_number", "5"), (None, "mood", "calm"), (0, "language", "eng"), (0, "handler_name", "h")]
    assert [(r.codec, r.mime_type) for r in containers.cover_art(files(spark, [movie])).orderBy("ord").collect()] == [("png", "image/png"), ("bmp", "image/bmp")]
    for kind, data_type, value, e in (("text", 9, b"x", None), ("pair", 0, bytes([0, 0, 0, 0, 0, 0]), None), ("pair", 0, bytes([0, 0, 0, 1, 0, 9]), "1/9"), ("genre", 0, b"\0\0", None), ("int8", 0, b"\7", "7")):
        assert boxes.tag_value(kind, data_type, value) == e


def test_damaged_input_gives_rows(spark):
    whole = [wav(fmt(), chunk(b"data", b"abcd")), mux.avi_file([b"\0" * 12], 2, 2, (25, 1)), mov_writer.movie([b"aa", b"b"], [1, 2], ilst=mov_writer.data_atom(b"\xa9nam", 1, b"t"))]
    cuts = [c[:n] for c in whole for n in range(0, len(c), 7)]
    flips = [c[:n] + bytes([c[n] ^ 0xFF]) + c[n + 1 :] for c in whole for n in range(0, len(c), 5)]
    df = files(spark, cuts + flips)
    for parse in (containers.wav_packets, containers.avi_packets, containers.y4m_packets, containers.mov_boxes, containers.mov_tracks, containers.mov_tables, containers.cover_art):
        rows = parse(df)
        assert rows.where("error is not null").count() > 0
    assert containers.mov_packets(df).count() >= 0 and containers.mov_tags(df).count() >= 0


def test_text_samples(spark):
    cue = mov_writer.box(b"vttc", mov_writer.box(b"vsid", struct.pack(">I", 7)), mov_writer.box(b"iden", b"cue-7"), mov_writer.box(b"ctim", b"00:00:01.500"), mov_writer.box(b"sttg", b"align:start size:50%"), mov_writer.box(b"payl", b"Hello\nworld"))
    samples = [mov_writer.box(b"vtta", b"NOTE imported comment") + cue, mov_writer.box(b"vtte"), b"", mov_writer.box(b"vtte") + cue, mov_writer.box(b"abcd"), mov_writer.box(b"vttc", mov_writer.box(b"payl", b"a\n\nb"))]
    packets = spark.createDataFrame([(1, i, bytearray(s)) for i, s in enumerate(samples)], "file_id bigint, packet_index bigint, payload binary")
    rows = decode.webvtt_cues(packets).orderBy("packet_index", "item").collect()
    assert [(r.packet_index, r.kind) for r in rows if r.error is None] == [(0, "additional"), (0, "cue"), (1, "empty")]
    assert (rows[1].source_id, rows[1].cue_id, rows[1].cue_time, rows[1].settings, rows[1].payload) == (7, "cue-7", "00:00:01.500", "align:start size:50%", "Hello\nworld")
    assert {r.packet_index for r in rows if r.error} == {2, 3, 4, 5}

    styl = mov_writer.box(b"styl", struct.pack(">H", 1), struct.pack(">HHHBB4s", 0, 2, 1, 1, 12, b"\xff\0\0\xff"))
    href = mov_writer.box(b"href", struct.pack(">HH", 0, 2), b"\x03url", b"\x03alt")
    krok = mov_writer.box(b"krok", struct.pack(">IH", 0, 1), struct.pack(">IHH", 10, 0, 1))
    texts = [struct.pack(">H", 2) + b"hi" + styl + href + krok + mov_writer.box(b"hlit", struct.pack(">HH", 0, 1)), struct.pack(">H", 6) + b"\xfe\xff\0h\0i", struct.pack(">H", 9) + b"short", struct.pack(">H", 1) + b"x" + styl]
    got = [r.sample for r in decode.timed_text(spark.createDataFrame([(1, i, bytearray(t)) for i, t in enumerate(texts)], "file_id bigint, packet_index bigint, payload binary")).orderBy("packet_index").collect()]
    assert (got[0].text, got[0].modifiers, got[0].styles[0].end, got[0].links[0].url, got[0].karaoke[0].end_time, got[0].highlights[0].end) == ("hi", 4, 2, "url", 10, 1)
    assert (got[1].text, got[1].encoding) == ("hi", "utf-16be") and got[2].error and got[3].error


def test_geometry_and_choice(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(decode.plane_sizes("yuv420p", F.lit(4), F.lit(2))) == [8, 2, 2] and one(decode.plane_sizes("yuv420p", F.lit(3), F.lit(2))) is None
    assert one(decode.frame_size("nv12", F.lit(4), F.lit(4))) == 24 and one(decode.frame_size("yuv444p10le", F.lit(2), F.lit(2))) == 24
    rows = spark.createDataFrame([("yuv422p",), ("rgba",), ("gray",), ("yuv420p10le",), (None,)], "src string")
    best = {r.src: r.best for r in decode.best_pixel_format(rows, "src", ["yuv420p", "yuv444p", "rgb24", "gray", "rgba"], True).collect()}
    assert best["rgba"] == "rgba" and best["gray"] == "gray" and best["yuv422p"] == "yuv444p" and best["yuv420p10le"] == "yuv420p" and best[None] is None
    known = decode.pixel_formats(spark)
    pairs = known.select(F.struct(*known.columns).alias("s")).crossJoin(known.select(F.struct(*known.columns).alias("d")))
    score = {(r.a, r.b): r.x for r in pairs.select(F.col("s.name").alias("a"), F.col("d.name").alias("b"), decode.conversion_score(F.col("s"), F.col("d"), False).alias("x")).collect()}
    assert score["rgb24", "gray"] < score["rgb24", "yuv444p"] < score["rgb24", "bgr24"] < score["rgb24", "rgb24"]
    assert score["cuda", "cuda"] == -1 and score["cuda", "gray"] == score["gray", "cuda"] == -2 and all(v is not None for v in score.values())
    assert score["rgb24", "pal8"] == decode.BASE - 3 * (65536 >> 2) - 65536 and score["pal8", "rgb24"] == decode.BASE
    names = [f.name for f in dims.PIXEL_FORMATS]
    assert len(names) == len(set(names)) and 260 <= len(names) <= 275
    sizes = {n: one(decode.frame_size(n, F.lit(w), F.lit(h))) for n, w, h in (("monow", 9, 3), ("rgb4", 5, 2), ("uyyvyy411", 5, 2), ("bayer_rggb16be", 3, 3), ("pal8", 3, 3), ("xv36le", 2, 2), ("p010be", 4, 2), ("nv24", 3, 3), ("yuva444p12le", 2, 1), ("gbrapf32le", 1, 1), ("y210le", 2, 1), ("x2rgb10le", 3, 1))}
    assert sizes == {"monow": 6, "rgb4": 6, "uyyvyy411": 24, "bayer_rggb16be": 18, "pal8": 9, "xv36le": 32, "p010be": 24, "nv24": 27, "yuva444p12le": 16, "gbrapf32le": 16, "y210le": 8, "x2rgb10le": 12}
    assert one(decode.frame_size("yuyv422", F.lit(3), F.lit(1))) is None and one(decode.plane_sizes("cuda", F.lit(4), F.lit(4))) is None
    assert one(decode.is_silent(F.lit(bytearray(b"")), "s16")) and not one(decode.is_silent(F.lit(bytearray(b"\0\x10\0")), "s16"))


def test_muxers_reject_what_does_not_fit(spark):
    packets = spark.createDataFrame([(1, 0, 0, bytearray(b"abcdef")), (1, 1, 0, bytearray(b"abc")), (2, 0, 0, bytearray(b""))], "file_id bigint, packet_index bigint, stream_index int, payload binary")
    good, bad = mux.mux_rawvideo(packets, 6)
    assert bytes(good.first().content) == b"abcdef" and bad.count() == 2
    images, bad = mux.mux_image_sequence(packets, "one.png")
    assert [(r.file_id, r.path) for r in images.collect()] == [(1, "one.png")] and bad.count() == 2
    assert mux.mux_avi(packets.where("file_id = 1"), 2, 1, (25, 1)).first().error
    with pytest.raises(ValueError):
        mux.mux_y4m(packets, 3, 2, (25, 1))


def test_files_in_and_out(spark, tmp_path):
    packets = spark.createDataFrame([(1, i, 0, bytearray(bytes([65 + i]) * 3)) for i in range(4)], "file_id bigint, packet_index bigint, stream_index int, payload binary")
    images, _ = mux.mux_image_sequence(packets, "img-%03d.bin", 2)
    assert mux.write_images(images, f"file://{tmp_path}").count() == 4
    found, large = media.read_media(spark, str(tmp_path), "*.bin", most_bytes=10)
    assert found.count() == 4 and large.count() == 0 and media.read_media(spark, str(tmp_path), most_bytes=2)[1].count() == 4
    rows = spark.createDataFrame([(1, "a,b"), (2, "c")], "file_id int, name string")
    reports.write_report(rows, str(tmp_path / "report"), "format", ["name"], "csv")
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ['format,"a,b"', "format,c"]
    reports.write_tables({"formats": rows}, str(tmp_path / "tables"), "name")
    assert spark.read.parquet(str(tmp_path / "tables/formats")).where("name = 'c'").first().file_id == 2


def test_assembled_samples_are_the_joined_ones(spark):
    key = "file_id int, track int, ord int, count bigint, value bigint"
    runs = lambda rows: spark.createDataFrame([(f, 0, i, n, v) for f, part in rows.items() for i, (n, v) in enumerate(part)], key)
    sizes, durations = runs({1: [(3, 2), (2, 9)], 2: [(4, 1)]}), runs({1: [(5, 10)], 2: [(1, 20), (3, 30)]})
    ctts = runs({1: [(1, 5), (4, 7)]})
    sync = spark.createDataFrame([(1, 0, 0), (1, 0, 3)], "file_id int, track int, sample bigint")
    chunks = spark.createDataFrame([(1, 0, 1, 2, 100), (1, 0, 2, 3, 200), (2, 0, 1, 4, 50)], "file_id int, track int, chunk bigint, samples bigint, chunk_offset bigint")
    columns = ["file_id", "track", "sample", "size", "duration", "ctts", "is_key", "chunk", "chunk_offset"]
    joined = S.zip_samples(S.expand_runs(sizes, "size"), S.expand_runs(durations, "duration"), S.expand_runs(ctts, "ctts"), sync)
    joined = joined.join(S.samples_in_chunks(chunks), ["file_id", "track", "sample"]).join(chunks.drop("samples"), ["file_id", "track", "chunk"])
    got = S.assemble_samples(sizes, durations, ctts, sync, chunks)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, joined.select(*columns).collect()))
    plain = S.assemble_samples(sizes, durations)
    assert plain.count() == 9 and plain.where("is_key and ctts = 0").count() == 9
    assert S.assemble_samples(runs({1: [(1 << 40, 1)]}), durations).count() == 0


def test_running_totals_of_assembled_samples_are_those_of_windows(spark):
    """Times and places come from run lengths; nothing after the tables is shuffled or sorted by sample."""
    key = "file_id int, track int, ord int, count bigint, value bigint"
    runs = lambda rows: spark.createDataFrame([(f, k, i, n, v) for (f, k), part in rows.items() for i, (n, v) in enumerate(part)], key)
    sizes, durations = runs({(1, 0): [(3, 2), (0, 7), (4, 9)], (1, 1): [(5, 1)], (2, 0): [(4, 3)]}), runs({(1, 0): [(2, 10), (3, 4)], (1, 1): [(1, 20), (9, 30)]})
    stsc = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 0, 1, 3, 3), (1, 1, 0, 1, 4), (2, 0, 0, 1, 1)], "file_id int, track int, ord int, first_chunk bigint, samples_per_chunk bigint")
    counts = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (2, 0, 2)], "file_id int, track int, chunk_count bigint")
    edits = spark.createDataFrame([(1, 0, 5, "mp4a"), (1, 1, 0, "avc1")], "file_id int, track int, media_time bigint, codec string")
    chunks = S.chunk_runs(stsc, counts).withColumn("chunk_offset", F.col("chunk") * 1000)
    joined = S.zip_samples(S.expand_runs(sizes, "size"), S.expand_runs(durations, "duration"), None, None).join(S.samples_in_chunks(chunks), [*S.TRACK, "sample"]).withColumn("chunk_offset", F.col("chunk") * 1000)
    columns = ["file_id", "track", "sample", "chunk", "size", "pos", "dts", "pts", "duration", "flags", "skip_samples"]
    rows = lambda df: sorted(df.select(*columns).collect(), key=str)
    want = rows(S.timeline(S.place_samples(joined), edits))
    spans = S.assemble_samples(sizes, durations, None, None, S.chunk_spans(stsc, counts), carried=edits).withColumn("chunk_offset", F.col("chunk") * 1000)
    placed = S.timeline(S.place_samples(spans))
    assert len(want) == 14 and rows(placed) == want and rows(S.timeline(S.place_samples(S.assemble_samples(sizes, durations, None, None, chunks)), edits)) == want
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and not {"Window", "Sort", "Exchange"} & set(plan.split("Generate")[0].replace("(", " ").split())


def test_key_samples_as_rows_and_as_lists(spark):
    runs = spark.createDataFrame([(1, 0, 0, 7, 1), (2, 0, 0, 3, 1)], "file_id int, track int, ord int, count bigint, value bigint")
    keys = spark.createDataFrame([(1, 0, k) for k in (6, 0, 3, 3)], "file_id int, track int, sample bigint")
    lists = keys.groupBy("file_id", "track").agg(F.collect_list("sample").alias("samples"))
    for sync in (keys, lists):
        got = {(r.file_id, r.sample) for r in S.assemble_samples(runs, runs, sync=sync).where("is_key").collect()}
        assert got == {(1, 0), (1, 3), (1, 6), (2, 0), (2, 1), (2, 2)}


def test_files_of_few_ranges_are_not_swept(spark):
    """Samples meet the few ranges of their file without being moved or sorted; files of many ranges are swept, and both give the same."""
    samples = spark.range(300).select((F.col("id") % 3).alias("file_id"), F.col("id").alias("sample"), F.col("id").alias("pos"), F.lit(5).cast("bigint").alias("size"))
    known = [(0, 10, 100), (0, 50, 180), *[(1, k * 20, k * 20 + 15) for k in range(12)]]
    ranges = spark.createDataFrame(known, "file_id bigint, start bigint, end bigint")
    want = [n for n in range(300) if any(f == n % 3 and a <= n and n + 5 <= b for f, a, b in known)]
    for few in (0, 2, 100):
        assert sorted(r.sample for r in S.inside_ranges(samples, ranges, True, few=few).collect()) == want
        assert S.inside_ranges(samples, ranges, False, few=few).count() == 300 - len(want)


def test_files_with_pictures_of_any_key(spark, tmp_path):
    """Keys beyond 16 bits: widths stay within theirs."""
    from cuemill.jobs import container_queries as Q

    spark.createDataFrame([(k, f"Customer#{k}") for k in (1, 64_999, 65_519, 65_520, 900_000)], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    assert Q.cover_pictures(spark, str(tmp_path)).count() == 5 and Q.sample_entries(spark, str(tmp_path)).count() == 5


def test_plane_sizes_as_numbers_are_those_of_columns(spark):
    names = [f.name for f in dims.PIXEL_FORMATS]
    for w, h in ((2, 2), (6, 4), (5, 3), (0, 2)):
        row = spark.range(1).select(*[decode.plane_sizes(n, F.lit(w), F.lit(h)).alias(n) for n in names]).first()
        assert [decode.frame_plane_sizes(n, w, h) for n in names] == list(row)


def test_small_files_share_their_batches(spark):
    """Parsed rows of many files are one batch, not one each; a broken file among them is one row."""
    files = spark.createDataFrame([(k, bytearray(b"bad" if k == 7 else boxes.PNG)) for k in range(50)], "file_id bigint, content binary").coalesce(1)

    def parse(data):
        for k in range(3):
            yield {"n": k, "data": data}
            if data == b"bad" and k == 1:
                raise boxes.Bad("InvalidData", "broken")

    rows = containers.map_files(files, "n bigint, data binary", parse)
    sizes = rows.mapInPandas(lambda frames: (f.iloc[:1][["file_id"]].assign(file_id=len(f)) for f in frames), "file_id bigint").collect()
    got = rows.collect()
    assert [r.file_id for r in sizes] == [148] and len(got) == 148 and [(r.n, r.error_kind, r.error) for r in got if r.file_id == 7] == [(None, "InvalidData", "broken")]


def test_muxers_join_pieces_without_python(spark):
    packets = spark.createDataFrame([(1, k, 0, bytearray(bytes([k]) * 6) if k != 5 else None) for k in (3, 0, 11, 5, 2)], "file_id bigint, packet_index bigint, stream_index int, payload binary")
    out = mux.mux_pcm(packets)
    assert bytes(out.first().content) == b"".join(bytes([k]) * 6 for k in (0, 2, 3, 11)) and "Python" not in out._jdf.queryExecution().toString()
    assert bytes(mux.mux_pcm(packets.where("payload is null")).first().content) == b""
    whole = packets.where("payload is not null")
    assert bytes(mux.mux_avi(whole, 2, 1, (25, 1)).first().content) == mux.avi_file([bytes([k]) * 6 for k in (0, 2, 3, 11)], 2, 1, (25, 1)) and "FlatMapGroups" not in mux.mux_avi(whole, 2, 1, (25, 1))._jdf.queryExecution().toString()
