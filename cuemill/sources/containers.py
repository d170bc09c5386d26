"""Container files as tables: vectorised helpers around the byte layouts.

Every function takes files (``file_id, content`` among others) and reads each file's bytes
once, in the task that holds them. A broken file gives one row with ``error_kind, error``
and nulls; ``split_errors`` takes those apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import exploded
from ..operators import sample_tables
from ..store import written
from . import boxes

PACKET = "packet_index bigint, stream_index int, pts bigint, dts bigint, duration bigint, size bigint, pos bigint, flags int, payload binary"
ERROR = "error_kind string, error string"


#: Rows and payload bytes that are handed on at once.
ROWS, BYTES = 10_000, 16 << 20
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def map_files(files: DataFrame, schema: str, parse: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Rows ``file_id, <schema>, error_kind, error`` from each file's bytes; rows of many small files are handed on together."""
    fields = [c.split() for c in f"{schema}, {ERROR}".split(", ")]
    names, types = [n for n, _ in fields], [_TYPES[t] for _, t in fields]
    heavy = [n for n, t in fields if t == "binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            kinds = [batch.schema.field("file_id").type, *types]
            table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file_id", *names])
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content")):
                try:
                    found = list(parse(content.as_py() or b""))
                except boxes.Bad as e:
                    found = [{"error_kind": e.kind, "error": str(e)}]
                for r in found:
                    rows.append((file_id, *map(r.get, names)))
                    held += sum(len(r.get(n) or b"") for n in heavy)
                    if len(rows) >= ROWS or held >= BYTES:
                        yield table()
                        rows, held = [], 0
            if rows:
                yield table()
                rows, held = [], 0

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInArrow(run, f"file_id {kind}, {schema}, {ERROR}")


def _packet(index: int, stream: int, pts: int, duration: int, pos: int, payload: bytes) -> dict:
    return {"packet_index": index, "stream_index": stream, "pts": pts, "dts": pts, "duration": duration, "size": len(payload), "pos": pos, "flags": 1, "payload": payload}


def places(content: Column, locate: Callable[[bytes], Iterator[tuple[int, int, int, int]]]) -> Column:
    """``stream, pos, size, pts`` as lists over a file's packets, by ``locate``, and ``error_kind, error``; no payload comes out of Python."""

    @F.arrow_udf("struct<stream:array<int>,pos:array<bigint>,size:array<bigint>,pts:array<bigint>,error_kind:string,error:string>")
    def run(contents: pa.Array) -> pa.Array:
        ends, problems, files = [0], [], [np.empty((0, 4), np.int64)]
        for data in contents:
            try:
                found = np.array(list(locate(data.as_py() or b"")), np.int64).reshape(-1, 4)
                problems.append((None, None))
            except boxes.Bad as e:
                found = files[0]
                problems.append((e.kind, str(e)))
            files.append(found)
            ends.append(ends[-1] + len(found))
        columns = np.concatenate(files).T
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.int64()).cast(t)) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        return pa.StructArray.from_arrays([*lists, *(pa.array([p[k] for p in problems], pa.string()) for k in (0, 1))], names=["stream", "pos", "size", "pts", "error_kind", "error"])

    return run(content)


def located(files: DataFrame, locate: Callable[[bytes], Iterator[tuple[int, int, int, int]]]) -> DataFrame:
    """Packets of files by ``locate`` (stream, place, size, time of each), with ``error_kind, error`` as of ``map_files``; payloads are cut where the file lies."""
    rows = files.select("file_id", "content", places(F.col("content"), locate).alias("_p"))

    def packet(i: Column, v: Column) -> Column:
        at = {c: F.get(v["_p"][c], i.cast("int")) for c in ("stream", "pos", "size", "pts")}
        return F.struct(i.alias("i"), *[at[c].alias(c) for c in at], F.substring(v["content"], (at["pos"] + 1).cast("int"), at["size"].cast("int")).alias("payload"), v["_p"]["error_kind"].alias("error_kind"), v["_p"]["error"].alias("error"))

    n = F.when(F.col("_p.error").isNotNull(), 1).otherwise(F.size("_p.pos"))  # an error is a row without a packet
    found, one = exploded(rows, n, packet, ["file_id"], ["content", "_p"]), F.when(F.col("_x.pos").isNotNull(), 1)
    return found.select("file_id", F.when(one.isNotNull(), F.col("_x.i")).alias("packet_index"), F.col("_x.stream").alias("stream_index"), F.col("_x.pts").alias("pts"), F.col("_x.pts").alias("dts"), one.cast("bigint").alias("duration"), "_x.size", "_x.pos", one.alias("flags"), "_x.payload", "_x.error_kind", "_x.error")


# --- WAV


def _wav_streams(data: bytes) -> Iterator[dict]:
    info = boxes.wav(data)
    if error := boxes.wav_error(info):
        raise boxes.Bad("InvalidData", error)
    yield {"stream_index": 0, "codec_type": "audio", "codec_name": "pcm_s16le", "channels": info["channels"], "sample_rate": info["sample_rate"], "bits_per_sample": info["bits_per_sample"], "duration_ts": len(info["payload"]) // info["block_align"]}


def _wav_packets(data: bytes) -> Iterator[dict]:
    info = boxes.wav(data)
    if error := boxes.wav_error(info):
        raise boxes.Bad("InvalidData", error)
    if info["payload"]:
        yield _packet(0, 0, 0, len(info["payload"]) // info["block_align"], info["pos"], info["payload"])


def wav_streams(files: DataFrame) -> DataFrame:
    return map_files(files, "stream_index int, codec_type string, codec_name string, channels int, sample_rate bigint, bits_per_sample int, duration_ts bigint", _wav_streams)


def wav_packets(files: DataFrame) -> DataFrame:
    """The whole data chunk as one packet at 0; none if it is empty."""
    return map_files(files, PACKET, _wav_packets)


def wav_headers(files: DataFrame) -> DataFrame:
    """Declared header numbers, unchecked, for ``validate_wav``."""
    return map_files(files, "channels int, sample_rate bigint, byte_rate bigint, block_align int, bits_per_sample int", lambda data: iter([boxes.wav(data)]))


def validate_wav(headers: DataFrame) -> DataFrame:
    """Adds ``problem``: what in a 16-bit PCM header doesn't follow from the rest; null if all does."""
    align = F.col("channels") * 2
    problem = (
        F.when((F.col("channels") <= 0) | (F.col("sample_rate") <= 0), "channels and sample rate must be positive")
        .when(F.col("bits_per_sample") != 16, "unsupported bits per sample")
        .when(F.col("block_align") != align, "block align does not match")
        .when(F.col("byte_rate") != F.col("sample_rate") * F.col("block_align"), "byte rate does not match")
    )
    return headers.withColumn("problem", problem)


# --- AVI


def avi_streams(files: DataFrame) -> DataFrame:
    def parse(data: bytes) -> Iterator[dict]:
        info = boxes.avi(data)
        for i, s in enumerate(info["streams"]):
            yield {**s, "stream_index": i, "codec_type": "video", "codec_tag_string": s["compression"], "declared_streams": info["header"]["streams"], "nb_frames": s["length"], "duration_ts": s["length"]}

    return map_files(files, "stream_index int, codec_type string, codec_tag_string string, handler string, width int, height int, bit_count int, scale bigint, rate bigint, nb_frames bigint, duration_ts bigint, declared_streams int", parse)


def avi_packets(files: DataFrame) -> DataFrame:
    """Video chunks in file order; timestamps count per stream, positions are absolute."""

    def locate(data: bytes) -> Iterator[tuple[int, int, int, int]]:
        count: dict[int, int] = {}
        for p in boxes.avi(data, payloads=False)["packets"]:
            n = count[p["stream_index"]] = count.get(p["stream_index"], -1) + 1
            yield p["stream_index"], p["pos"], p["size"], n

    return located(files, locate)


def validate_avi(streams: DataFrame) -> DataFrame:
    """``file_id, problem`` of files whose declared stream count, rates or dimensions don't hold."""
    each = streams.groupBy("file_id").agg(F.count("*").alias("n"), F.max("declared_streams").alias("declared"), F.min(F.least("scale", "rate")).alias("rate"), F.min(F.least("width", "height")).alias("side"))
    problem = F.when(F.col("n") != F.col("declared"), "declared stream count differs").when(F.col("rate") <= 0, "rate and scale must not be 0").when(F.col("side") <= 0, "dimensions must not be 0")
    return each.select("file_id", problem.alias("problem")).where("problem is not null")


# --- YUV4MPEG2


def y4m_streams(files: DataFrame) -> DataFrame:
    def parse(data: bytes) -> Iterator[dict]:
        info = boxes.y4m(data)
        yield {"stream_index": 0, "codec_type": "video", "width": info["width"], "height": info["height"], "rate_num": info["rate"][0], "rate_den": info["rate"][1], "sample_aspect_ratio": info["sar"], "color_range": info["color_range"], "nb_frames": len(info["frames"])}

    return map_files(files, "stream_index int, codec_type string, width int, height int, rate_num int, rate_den int, sample_aspect_ratio string, color_range string, nb_frames bigint", parse)


def y4m_places(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Stream, place, size and time of every frame."""
    info = boxes.y4m(data, payloads=False)
    return ((0, pos, info["frame_bytes"], i) for i, (pos, _) in enumerate(info["frames"]))


def y4m_packets(files: DataFrame) -> DataFrame:
    return located(files, y4m_places)


# --- MOV


def mov_boxes(files: DataFrame) -> DataFrame:
    """One row per box: ``path, type, start, end``, depth first; start is behind the header."""

    def parse(data: bytes) -> Iterator[dict]:
        for i, (path, kind, a, b) in enumerate(boxes.boxes(data)):
            yield {"ord": i, "path": path, "type": kind.decode("latin-1"), "start": a, "end": b}

    return map_files(files, "ord bigint, path string, type string, start bigint, end bigint", parse)


#: What a sample entry tells of its track.
_ENTRY = ("fourcc", "kind", "channels", "sample_rate", "bits_per_sample", "bits_per_raw_sample", "profile", "level", "nal_length_size", "is_avc", "extradata_size", "h_spacing", "v_spacing", "primaries", "transfer", "matrix", "full_range")


def _track_rows(data: bytes) -> Iterator[dict]:
    movie = boxes.mov(data)
    for t in movie["tracks"]:
        entry = boxes.sample_entry(t["stsd"]) if "stsd" in t else {}
        yield {
            "track": t["index"], "id": t.get("id"), "width": t.get("width") or entry.get("width"), "height": t.get("height") or entry.get("height"), "handler": t.get("handler"), "handler_name": t.get("handler_name"),
            "timescale": t.get("timescale"), "duration_ts": t.get("duration"), "language": t.get("language"), "nb_frames": sum(n for n, _ in t.get("stsz", [])),
            "media_time": next((m for m in t.get("elst", []) if m >= 0), None), **{f: entry.get(f) for f in _ENTRY},
        }


def mov_tracks(files: DataFrame) -> DataFrame:
    """One row per track: ids, dimensions, handler, times, counts and what the first sample entry tells."""
    schema = "track int, id bigint, width int, height int, handler string, handler_name string, timescale bigint, duration_ts bigint, language int, nb_frames bigint, media_time bigint, fourcc string, kind string, channels int, sample_rate bigint, bits_per_sample int, bits_per_raw_sample int, profile int, level int, nal_length_size int, is_avc boolean, extradata_size int, h_spacing bigint, v_spacing bigint, primaries int, transfer int, matrix int, full_range boolean"
    return map_files(files, schema, _track_rows)


def _track_tables(t: dict) -> Iterator[dict]:
    for name in ("stts", "ctts", "stsz", "stsc"):
        for i, row in enumerate(t.get(name, [])):
            yield {"table": name, "track": t["index"], "ord": i, **dict(zip("abc", row))}
    for name in ("stco", "stss", "elst"):
        for i, v in enumerate(t.get(name, [])):
            yield {"table": name, "track": t["index"], "ord": i, "a": v}


def mov_tables(files: DataFrame) -> DataFrame:
    """Raw run-length tables as tagged rows ``table, track, ord, a, b, c``; nothing is expanded.

    stts, ctts and stsz: count and value; stsc: first chunk, samples per chunk, description;
    stco: offset; stss: sample number; elst: media time; mdat (track null): start and end.
    """

    def parse(data: bytes) -> Iterator[dict]:
        movie = boxes.mov(data)
        for i, (a, b) in enumerate(movie["mdat"]):
            yield {"table": "mdat", "ord": i, "a": a, "b": b}
        for t in movie["tracks"]:
            yield from _track_tables(t)

    return map_files(files, "table string, track int, ord bigint, a bigint, b bigint, c bigint", parse)


def mov_packets(files: DataFrame) -> DataFrame:
    """``file_id, track, sample, size, pos, dts, pts, duration, flags, skip_samples`` of every track, by expanding its tables.

    Files are parsed once: tables and tracks go into one written table, from which the rest derives.
    """

    def parse(data: bytes) -> Iterator[dict]:
        movie = boxes.mov(data)
        for t in movie["tracks"]:
            entry = boxes.sample_entry(t["stsd"]) if "stsd" in t else {}
            yield {"table": "track", "track": t["index"], "a": next((m for m in t.get("elst", []) if m >= 0), 0), "codec": entry.get("fourcc")}
            yield from _track_tables(t)

    raw = written(map_files(files, "table string, track int, ord bigint, a bigint, b bigint, c bigint, codec string", parse).where("error is null"), "mov-tables", "table")
    tracks = raw.where("table = 'track'").select("file_id", "track", F.col("a").alias("media_time"), "codec")
    return expanded_packets(raw, tracks)


def expanded_packets(raw: DataFrame, tracks: DataFrame) -> DataFrame:
    """Packets of every track from its raw tables (as of ``mov_tables``) and ``media_time, codec``."""
    key = ["file_id", "track"]

    def rows(name: str, **columns: str) -> DataFrame:
        return raw.where(F.col("table") == name).select(*key, "ord", *[F.col(v).alias(k) for k, v in columns.items()])

    runs = {"count": "a", "value": "b"}
    sync = rows("stss", number="a").select(*key, (F.col("number") - 1).alias("sample"))
    offsets = rows("stco", chunk_offset="a").withColumn("chunk", F.col("ord") + 1).drop("ord")
    entries = sample_tables.chunk_runs(rows("stsc", first_chunk="a", samples_per_chunk="b"), offsets.groupBy(*key).agg(F.count("*").alias("chunk_count")))
    samples = sample_tables.assemble_samples(rows("stsz", **runs), rows("stts", **runs), rows("ctts", **runs), sync, entries.join(offsets, [*key, "chunk"]))
    return sample_tables.timeline(sample_tables.place_samples(samples), tracks).select(*key, "sample", "size", "pos", "dts", "pts", "duration", "flags", "skip_samples")


def mov_tags(files: DataFrame) -> DataFrame:
    """Tag rows ``owner, ord, key, value``: movie tags (owner null) and, per track, its own tags, then language and handler name."""
    from ..functions.tags import language_code

    def whole(rows: Callable[[], Iterator]) -> list:
        """All rows or, of what is broken, none: a file's tags and its tracks are read apart."""
        try:
            return list(rows())
        except boxes.Bad:
            return []

    def parse(data: bytes) -> Iterator[dict]:
        for i, (owner, key, value) in enumerate(whole(lambda: boxes.ilst_items(data)[0])):
            yield {"owner": int(owner[5:-1]) if owner else None, "ord": i, "key": key, "value": value}
        for t in whole(lambda: _track_rows(data)):
            yield {"owner": t["track"], "ord": 1 << 40, "key": "language", "language": t["language"] or 0}
            yield {"owner": t["track"], "ord": (1 << 40) + 1, "key": "handler_name", "value": t["handler_name"] or None}

    rows = map_files(files, "owner int, ord bigint, key string, value string, language int", parse)
    value = F.when(F.col("language").isNull(), F.col("value")).otherwise(language_code(F.col("language")))
    return rows.select("file_id", "owner", "ord", "key", value.alias("value")).where("value is not null")


def cover_art(files: DataFrame) -> DataFrame:
    """``ord, codec, mime_type, data`` of pictures in the tags; a PNG signature corrects the declared type."""

    def parse(data: bytes) -> Iterator[dict]:
        for i, (_, codec, mime, value) in enumerate(boxes.ilst_items(data)[1]):
            yield {"ord": i, "codec": codec, "mime_type": mime, "data": value}

    return map_files(files, "ord bigint, codec string, mime_type string, data binary", parse)
