"""What is in a file: probing, container detection, names, and report projections.

The registry of formats is a short list given by the caller. It becomes one array of
candidates per file row, so probing needs no join and no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timebase
from . import dims

SIGNATURE, MIME, EXTENSION = 100, 75, 50


@dataclass(frozen=True)
class Descriptor:
    """A format: file extensions, MIME types, and signatures as (offset, bytes)."""

    name: str
    extensions: tuple[str, ...] = ()
    mime_types: tuple[str, ...] = ()
    signatures: tuple[tuple[int, bytes], ...] = ()

    def __post_init__(self) -> None:
        for text in (self.name, *self.extensions, *self.mime_types):
            if not text or "\0" in text:
                raise ValueError("names must be non-empty and free of NUL")


DEFAULT_REGISTRY = (
    Descriptor("avi", ("avi",), ("video/x-msvideo",), ((8, b"AVI "),)),
    Descriptor("mov,mp4,m4a,3gp,3g2,mj2", ("mov", "mp4", "m4a", "3gp", "3g2", "mj2"), ("video/mp4", "video/quicktime"), ((4, b"ftyp"),)),
)


def extension_of(path: Column) -> Column:
    """Lower-cased text after the last dot of the last path part, or that part if it has none; null if empty."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.nullif(F.lower(F.ltrim(F.regexp_extract(name, r"[^.]*$", 0))), F.lit(""))


def _has(content: Column, offset: int, what: bytes) -> Column:
    return F.substring(content, offset + 1, len(what)) == F.lit(what)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return F.coalesce(out, F.lit(False))


def probe_formats(files: DataFrame, registry: Sequence[Descriptor] = DEFAULT_REGISTRY, mime: str | None = None) -> DataFrame:
    """Adds ``format_name, probe_score``: the best descriptor, the earlier of equals; null and 0 if none fits."""
    extension = extension_of(F.col("path"))
    candidates = []
    for i, d in enumerate(registry):
        score = F.when(_any([_has(F.col("content"), o, b) for o, b in d.signatures]), SIGNATURE)
        if mime:
            score = score.when(_any([F.lower(F.col(mime)) == m.lower() for m in d.mime_types]), MIME)
        score = score.when(_any([extension == e.lstrip(".").lower() for e in d.extensions]), EXTENSION).otherwise(0)
        candidates.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(d.name).alias("name")))
    best = F.array_max(F.array(*candidates))
    return files.withColumn("_best", best).select(*files.columns, F.when(F.col("_best.score") > 0, F.col("_best.name")).alias("format_name"), F.col("_best.score").alias("probe_score"))


def detect_container(files: DataFrame) -> DataFrame:
    """Adds ``container`` by a fixed cascade: WAV, AVI, YUV4MPEG2, MOV; null if none."""
    head, extension = F.col("content"), extension_of(F.col("path"))
    riff = _has(head, 0, b"RIFF")
    container = (
        F.when((riff & _has(head, 8, b"WAVE")) | (extension == "wav"), "wav")
        .when((riff & _has(head, 8, b"AVI ")) | (extension == "avi"), "avi")
        .when(_has(head, 0, b"YUV4MPEG2") | (extension == "y4m"), "yuv4mpegpipe")
        .when(_has(head, 4, b"ftyp") | extension.isin("mov", "mp4", "m4a", "3gp", "3g2", "mj2"), "mov")
    )
    return files.withColumn("container", container)


# --- names


def _named(code: Column, names: dict, default: str | None = "unknown") -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in names.items():
        out = out.when(code == F.lit(k), v)
    return F.when(code.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(default)))


def codec_name(fourcc: Column) -> Column:
    return _named(fourcc, {k: v[0] for k, v in dims.CODECS.items()}, None)


def codec_long_name(fourcc: Column) -> Column:
    return _named(fourcc, {k: v[1] for k, v in dims.CODECS.items()}, None)


def codec_type(handler: Column, entry_kind: Column, width: Column, height: Column, need_both: bool = False) -> Column:
    """Stream type by handler, else by the kind of sample entry, else video if it has dimensions.

    Reports take width or height as enough; stream hashes need both.
    """
    sized = (width.isNotNull() & height.isNotNull()) if need_both else (width.isNotNull() | height.isNotNull())
    kind = F.when(entry_kind.isin("audio", "video", "subtitle", "data"), entry_kind)
    return F.coalesce(_named(handler, dims.HANDLERS, None), kind, F.when(sized, "video"), F.lit("unknown"))


def profile_name(codec: Column, code: Column) -> Column:
    return F.when(codec == "h264", _named(code, dims.AVC_PROFILES)).when(codec == "hevc", _named(code, dims.HEVC_PROFILES))


def color_names(space: Column, transfer: Column, primaries: Column) -> list[Column]:
    return [_named(space, dims.COLOR_SPACES).alias("color_space"), _named(transfer, dims.COLOR_TRANSFERS).alias("color_transfer"), _named(primaries, dims.COLOR_PRIMARIES).alias("color_primaries")]


def codec_tag_hex(fourcc: Column) -> Column:
    """The four bytes as a little-endian number: ``0x%08x``, and ``0x0000`` for zero; null for other lengths."""
    b = F.hex(fourcc.cast("binary"))
    swapped = F.lower(F.concat(*[F.substring(b, i, 2) for i in (7, 5, 3, 1)]))
    return F.when(F.length(b) == 8, F.when(swapped == "00000000", "0x0000").otherwise(F.concat(F.lit("0x"), swapped)))


def sample_aspect_ratio(horizontal: Column, vertical: Column) -> Column:
    return timebase.reduce_ratio(horizontal, vertical, ":")


def display_aspect_ratio(width: Column, height: Column, horizontal: Column, vertical: Column) -> Column:
    return timebase.reduce_ratio(width * horizontal, height * vertical, ":")


def nearest_rate(rate: timebase.Rate, candidates: Sequence[tuple[int, int]]) -> Column:
    """The candidate nearest to a rate, by exact cross-multiplied distance; the first of equals. BIGINT index."""
    n, d = timebase.parts(rate)
    # |n/d - cn/cd| as a fraction over d * cd; d is common to all candidates
    each = [F.struct(F.abs(n * cd - F.lit(cn) * d).cast("decimal(19,0)").alias("num"), F.lit(cd).cast("decimal(10,0)").alias("den"), F.lit(i).cast("bigint").alias("index")) for i, (cn, cd) in enumerate(candidates)]
    return F.reduce(F.array(*each[1:]), each[0], lambda best, x: F.when(x["num"] * best["den"] < best["num"] * x["den"], x).otherwise(best))["index"]


# --- report projections

#: Report fields in their order.
FORMAT_FIELDS = ("filename", "nb_streams", "nb_programs", "nb_stream_groups", "format_name", "format_long_name", "time_base", "duration_ts", "duration", "size", "probe_score")
STREAM_FIELDS = (
    "index", "id", "codec_name", "codec_long_name", "profile", "codec_type", "codec_tag_string", "codec_tag", "width", "height", "coded_width", "coded_height",
    "sample_rate", "channels", "bits_per_sample", "bits_per_raw_sample", "extradata_size", "is_avc", "nal_length_size", "sample_aspect_ratio", "display_aspect_ratio",
    "color_range", "color_space", "color_transfer", "color_primaries", "field_order", "level", "time_base", "start_pts", "start_time", "r_frame_rate",
    "avg_frame_rate", "duration_ts", "duration", "nb_frames", "nb_read_frames", "nb_read_packets",
)
PACKET_FIELDS = ("codec_type", "stream_index", "pts", "pts_time", "dts", "dts_time", "duration", "duration_time", "size", "pos", "flags", "data", "data_hash")


def _completed(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """With a null text column for every field that isn't there."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in fields if c not in rows.columns})


def show_formats(files: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """One row per file, 11 fields in report order; what a container doesn't tell is null."""
    if streams is not None:
        files = files.join(streams.groupBy("file_id").agg(F.count("*").alias("nb_streams")), "file_id", "left")
    rows = _completed(files, ("nb_streams", *FORMAT_FIELDS)).withColumns({"filename": F.col("path"), "nb_streams": F.coalesce(F.col("nb_streams").cast("bigint"), F.lit(0)), "nb_programs": F.lit(0), "nb_stream_groups": F.lit(0), "size": F.col("length")})
    return rows.select("file_id", *FORMAT_FIELDS)


def show_streams(streams: DataFrame) -> DataFrame:
    """One row per stream, 37 fields in report order; names and ratios are worked out where their codes are there."""
    rows = streams.withColumn("index", F.col("stream_index"))
    have = set(rows.columns)
    made: dict[str, Column] = {}
    if "fourcc" in have:
        made |= {"codec_name": codec_name(F.col("fourcc")), "codec_long_name": codec_long_name(F.col("fourcc")), "codec_tag": codec_tag_hex(F.col("fourcc")), "codec_tag_string": F.when(F.col("fourcc") == "\0\0\0\0", "[0][0][0][0]").otherwise(F.col("fourcc"))}
    if {"time_base", "duration_ts"} <= have:
        made["duration"] = timebase.format_time(F.col("duration_ts"), F.col("time_base"))
    if {"nb_frames", "duration_ts", "time_base"} <= have:
        made["avg_frame_rate"] = F.when((F.col("nb_frames") != 0) & (F.col("duration_ts") != 0), timebase.reduce_ratio(F.col("nb_frames") * F.col("time_base.den"), F.col("duration_ts") * F.col("time_base.num")))
    if "codec_type" in have:
        made["field_order"] = F.when(F.col("codec_type") == "video", "unknown")
    rows = rows.withColumns({k: v for k, v in made.items() if k not in have})
    return _completed(rows, STREAM_FIELDS).select("file_id", *STREAM_FIELDS)


def show_packets(packets: DataFrame) -> DataFrame:
    """One row per packet in report order: joined with its stream's type and time base, times as text."""
    from .packets import flags_text

    tb = F.col("time_base")
    times = {f"{c}_time": timebase.format_time(F.col(c), tb) for c in ("pts", "dts", "duration")}
    extra = {c: F.lit(None).cast("string") for c in ("pos", "data", "data_hash") if c not in packets.columns}
    rows = packets.withColumns(times | extra).withColumn("flags", flags_text(F.col("flags")))
    return rows.select("file_id", "packet_index", *PACKET_FIELDS)


def parse_entries(spec: str) -> dict[str, list[str] | None]:
    """``section=field,field:section`` as fields by section; None means all. Repeats merge; an unknown section is an error."""
    chosen: dict[str, list[str] | None] = {}
    for part in filter(None, spec.split(":")):
        section, _, fields = part.partition("=")
        if section not in ("format", "stream", "packet", "format_tags", "stream_tags"):
            raise ValueError(f"unknown section {section!r}")
        if not fields:
            chosen[section] = None
        elif chosen.get(section, []) is not None:
            chosen[section] = [*(chosen.get(section) or []), *fields.split(",")]
    return chosen


def select_entries(tables: dict[str, DataFrame], spec: str) -> dict[str, DataFrame]:
    """The chosen sections with the chosen fields, in table order; unknown fields are ignored."""
    keys = ("file_id", "stream_index", "packet_index")
    out = {}
    for section, fields in parse_entries(spec).items():
        if section in tables:
            df = tables[section]
            out[section] = df if fields is None else df.select(*[c for c in df.columns if c in keys or c in fields])
    return out


def select_tags(tags: Column, keys: Sequence[str] | None) -> Column:
    """Tags with one of the keys, in their order; all for None."""
    return tags if keys is None else F.filter(tags, lambda t: t["key"].isin(*keys))


def with_stream_params(files: DataFrame, container: str, **options: object) -> DataFrame:
    """Force a format: its options become columns. Signed formats are still checked, raw ones need their options."""
    need = {"s16le": ("sample_rate", "channels"), "rawvideo": ("width", "height", "pix_fmt", "rate")}.get(container, ())
    if missing := [n for n in need if n not in options]:
        raise ValueError(f"{container} needs {', '.join(missing)}")
    signs = {"wav": [(0, b"RIFF"), (8, b"WAVE")], "avi": [(0, b"RIFF"), (8, b"AVI ")], "yuv4mpegpipe": [(0, b"YUV4MPEG2")], "mov": [(4, b"ftyp")]}.get(container, [])
    ok = F.lit(True)
    for o, b in signs:
        ok = ok & _has(F.col("content"), o, b)
    error = F.when(~F.coalesce(ok, F.lit(False)), f"not a {container} file")
    return files.withColumn("container", F.lit(container)).withColumns({k: F.lit(v) for k, v in options.items()}).withColumn("error", error)
