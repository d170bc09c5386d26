"""From packets to samples, planes, text and cues; geometry of formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import boxes
from . import dims


def decode_pcm(packets: DataFrame, channels: int) -> tuple[DataFrame, DataFrame]:
    """``file_id, packet_index, pts, channel, samples ARRAY<SMALLINT>`` of s16le payloads, and packets that don't hold whole sample frames."""
    whole = F.octet_length("payload") % (2 * channels) == 0
    kind = packets.schema["file_id"].dataType.simpleString()

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, index, pts, payload in frame.itertuples(index=False, name=None):
                samples = np.frombuffer(bytes(payload), "<i2").reshape(-1, channels)
                rows += [(file_id, index, pts, c, samples[:, c].copy()) for c in range(channels)]
            yield pd.DataFrame(rows, columns=["file_id", "packet_index", "pts", "channel", "samples"])

    good = packets.where(whole).select("file_id", "packet_index", "pts", "payload")
    bad = packets.where(~whole).select("file_id", "packet_index", F.lit("payload does not hold whole sample frames").alias("error"))
    return good.mapInPandas(decode, f"file_id {kind}, packet_index bigint, pts bigint, channel int, samples array<smallint>"), bad


def validate_payload_len(packets: DataFrame, expected: Column | int, exact: bool = True) -> DataFrame:
    """Packets whose payload isn't one frame, or for ``exact=False`` no multiple of one."""
    size = F.octet_length("payload")
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    return packets.where((size != expected) if exact else (size % expected != 0))


def plane_sizes(name: str, width: Column, height: Column) -> Column:
    """Bytes of each plane as ARRAY<BIGINT>; null where dimensions aren't positive or chroma doesn't divide them, and for frames that live in devices."""
    f = next((x for x in dims.PIXEL_FORMATS if x.name == name), None)
    if f is None:
        raise ValueError(f"no geometry for pixel format {name!r}")
    if not f.plane_bytes:
        return F.lit(None).cast("array<bigint>")
    w, h = width.cast("bigint"), height.cast("bigint")
    ok = (w > 0) & (h > 0)
    if not f.loose:
        ok = ok & (w % (1 << f.chroma_w) == 0) & (h % (1 << f.chroma_h) == 0)
    groups = w if f.group == 1 else F.floor((w + f.group - 1) / f.group)
    chroma = F.shiftright(w, f.chroma_w) * F.shiftright(h, f.chroma_h)
    planes = [(chroma if f.planar_chroma and i in (1, 2) else groups * h) * b for i, b in enumerate(f.plane_bytes)]
    return F.when(ok, F.array(*planes))


def frame_size(name: str, width: Column, height: Column) -> Column:
    return F.aggregate(plane_sizes(name, width, height), F.lit(0).cast("bigint"), lambda a, x: a + x)


def split_planes(packets: DataFrame, name: str, width: int, height: int) -> DataFrame:
    """``file_id, packet_index, pts, plane, size, data`` of payloads that are exactly one frame."""
    sizes = frame_plane_sizes(name, width, height)
    if sizes is None:
        sizes = []
    planes = [F.struct(F.lit(k).alias("plane"), F.lit(n).cast("bigint").alias("size"), F.lit(sum(sizes[:k])).alias("start")) for k, n in enumerate(sizes)]
    spans = F.array(*planes) if planes else F.array().cast("array<struct<plane:int,size:bigint,start:int>>")
    rows = packets.where(F.octet_length("payload") == sum(sizes))
    each = rows.select("file_id", "packet_index", "pts", "payload", F.explode(spans).alias("s"))
    return each.select("file_id", "packet_index", "pts", "s.plane", "s.size", F.substring(F.col("payload"), F.col("s.start") + 1, F.col("s.size").cast("int")).alias("data"))


def frame_plane_sizes(name: str, width: int, height: int) -> list[int] | None:
    """``plane_sizes`` of one known geometry, as numbers."""
    f = next((x for x in dims.PIXEL_FORMATS if x.name == name), None)
    if f is None:
        raise ValueError(f"no geometry for pixel format {name!r}")
    fits = width > 0 and height > 0 and (f.loose or width % (1 << f.chroma_w) == 0 and height % (1 << f.chroma_h) == 0)
    if not f.plane_bytes or not fits:
        return None
    groups, chroma = -(-width // f.group), (width >> f.chroma_w) * (height >> f.chroma_h)
    return [(chroma if f.planar_chroma and i in (1, 2) else groups * height) * b for i, b in enumerate(f.plane_bytes)]


def is_silent(payload: Column, sample_format: str) -> Column:
    """Every byte is the format's silence: 0x80 for unsigned samples, else 0. An empty payload is silent."""
    byte = "80" if sample_format.startswith("u8") else "00"
    return F.replace(F.hex(payload), F.lit(byte), F.lit("")) == "" if byte == "00" else F.hex(payload).rlike("^(80)*$")


def sample_frame_bytes(sample_format: str, channels: Column) -> Column:
    f = next(x for x in dims.SAMPLE_FORMATS if x.name == sample_format)
    return channels.cast("bigint") * f.bytes


def sample_plane_sizes(sample_format: str, channels: Column, samples: Column) -> Column:
    """One plane per channel for planar formats, else one for all."""
    f = next(x for x in dims.SAMPLE_FORMATS if x.name == sample_format)
    each = samples.cast("bigint") * f.bytes
    return F.array_repeat(each, channels) if f.planar else F.array(each * channels)


# --- channel layouts


def channel_names(mask: Column) -> Column:
    """Names of the set bits, from the lowest."""
    names = [F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, name) for name, bit in sorted(dims.CHANNEL_BITS.items(), key=lambda x: x[1])]
    return F.array_compact(F.array(*names))


def layout_for_mask(mask: Column) -> Column:
    """Name of the known layout with exactly these channels, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for layout in dims.CHANNEL_LAYOUTS:
        out = out.when(mask == F.lit(layout.mask), layout.name)
    return out


def layout_for_count(channels: Column) -> Column:
    """Name of the first known layout with so many channels, or null."""
    out, seen = F.when(F.lit(False), F.lit(None).cast("string")), set()
    for layout in dims.CHANNEL_LAYOUTS:
        if len(layout.channels) not in seen:
            seen.add(len(layout.channels))
            out = out.when(channels == len(layout.channels), layout.name)
    return out


# --- choosing a pixel format

#: Scores of a format kept as it is, of any other before what it loses, and of frames that live in devices.
BEST, BASE, DEVICE, OTHER = (1 << 31) - 1, (1 << 31) - 2, -1, -2
FORMAT = "name string, color string, depths array<int>, chroma_w int, chroma_h int, alpha boolean, paletted boolean, bits int"


def padded_bits(f: dims.PixelFormat) -> int:
    """Stored bits per pixel of a 16 x 16 frame."""
    chroma = (16 >> f.chroma_w) * (16 >> f.chroma_h)
    planes = [(chroma if f.planar_chroma and i in (1, 2) else 256 // f.group) * b for i, b in enumerate(f.plane_bytes)]
    return sum(planes) * 8 // 256


def pixel_formats(spark: SparkSession) -> DataFrame:
    """The formats as a small table."""
    rows = [(f.name, f.color, f.depths, f.chroma_w, f.chroma_h, f.alpha, f.paletted, padded_bits(f)) for f in dims.PIXEL_FORMATS]
    return spark.createDataFrame(rows, FORMAT)


def conversion_score(s: Column, d: Column, has_alpha: bool) -> Column:
    """How little a conversion from one format (a struct as in ``pixel_formats``) to another loses; higher is better.

    Fewer bits, coarser or finer chroma, another colour model, lost alpha and a palette cost.
    """
    zero = F.lit(0).cast("bigint")
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    n = F.least(F.size(s["depths"]), F.when(d["paletted"], 4).otherwise(F.size(d["depths"])))
    kept = lambda i: F.when(d["paletted"], F.floor(F.lit(7) / n).cast("int")).otherwise(F.get(d["depths"], i) - 1)
    more = lambda i: F.get(s["depths"], i) - 1 - kept(i)
    bits = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(more(i) > 0, -F.floor(F.lit(65536) / power(kept(i)))).otherwise(more(i)).cast("bigint")), zero, lambda a, x: a + x)
    chroma = zero
    for c in ("chroma_w", "chroma_h"):
        chroma = chroma - F.when(d[c] > s[c], F.lit(256) * power(d[c])).when(d[c] < s[c], power(s[c] - d[c])).otherwise(0)
    at = lambda x, k: (x["chroma_w"] == k) & (x["chroma_h"] == k)
    halved = F.when(at(d, 1) & at(s, 0), 512).when(at(d, 1) & at(s, 2), 4).otherwise(0)
    accepts = F.create_map(*[x for k, v in {"rgb": ("rgb", "gray"), "gray": ("gray",), "yuv": ("yuv",), "yuvj": ("yuvj", "yuv", "gray"), "xyz": ("xyz",)}.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    other = F.when(F.array_contains(F.try_element_at(accepts, d["color"]), s["color"]), 0).otherwise(F.floor(n * F.lit(65536) / power(F.least(F.get(s["depths"], F.lit(0)), F.get(d["depths"], F.lit(0))) - 1)))
    grayed = F.when((d["color"] == "gray") & (s["color"] != "gray"), 2 * 65536).otherwise(0)
    cut = F.when(s["alpha"] & ~d["alpha"] & F.lit(has_alpha), 65536).otherwise(0)
    palette = F.when(d["paletted"] & ~s["paletted"] & ((s["color"] != "gray") | (s["alpha"] & F.lit(has_alpha))), 65536).otherwise(0)
    device = (F.size(s["depths"]) == 0) | (F.size(d["depths"]) == 0)
    return F.when(device, F.when(s["name"] == d["name"], DEVICE).otherwise(OTHER)).when(s["name"] == d["name"], BEST).otherwise(F.lit(BASE) + bits + chroma + halved - other - grayed - cut - palette).cast("bigint")


def best_pixel_format(formats: DataFrame, src: str, candidates: list[str], has_alpha: bool = False) -> DataFrame:
    """Adds ``best``: the candidate that loses least from the format named in column ``src``; null for an unknown format.

    Equal scores: fewer stored bits, then fewer components, then the earlier candidate. The
    choice is made once for every known format, in a table of fewer than 300 rows that is
    broadcast; rows are only joined to it.
    """
    known = pixel_formats(formats.sparkSession)
    by_name = {f.name: f for f in dims.PIXEL_FORMATS}
    if unknown := [c for c in candidates if c not in by_name]:
        raise ValueError(f"unknown pixel formats {unknown}")
    each = [(by_name[c], F.lit(i)) for i, c in enumerate(candidates)]
    made = [F.struct(F.lit(f.name).alias("name"), F.lit(f.color).alias("color"), F.array(*map(F.lit, f.depths)).cast("array<int>").alias("depths"), F.lit(f.chroma_w).alias("chroma_w"), F.lit(f.chroma_h).alias("chroma_h"), F.lit(f.alpha).alias("alpha"), F.lit(f.paletted).alias("paletted"), F.lit(padded_bits(f)).alias("bits"), i.alias("ord")) for f, i in each]
    ranked = F.array(*[F.struct((-conversion_score(F.col("s"), d, has_alpha)).alias("loss"), d["bits"].alias("bits"), F.size(d["depths"]).alias("parts"), d["ord"].alias("ord"), d["name"].alias("name")) for d in made])
    chosen = known.select(F.struct(*known.columns).alias("s")).select(F.col("s.name").alias("_src"), F.array_min(ranked)["name"].alias("best"))
    return formats.join(F.broadcast(chosen), F.col(src) == F.col("_src"), "left").drop("_src")


# --- text samples

TIMED_TEXT = "struct<text:string,encoding:string,chars:int,modifiers:int,styles:array<struct<start:int,end:int,font:int,face:int,size:int,color:string>>,links:array<struct<start:int,end:int,url:string,alt:string>>,karaoke:array<struct<start_time:bigint,end_time:bigint,start:int,end:int>>,highlights:array<struct<start:int,end:int>>,blinks:array<struct<start:int,end:int>>,error:string>"
CUES = "struct<items:array<struct<kind:string,source_id:bigint,cue_id:string,cue_time:string,settings:string,payload:string>>,error:string>"


def timed_text(packets: DataFrame) -> DataFrame:
    """Adds ``sample``, the parsed text sample, or its ``error``."""

    @F.pandas_udf(TIMED_TEXT)
    def parse(payloads: pd.Series) -> pd.DataFrame:
        names = ["text", "encoding", "chars", "modifiers", "styles", "links", "karaoke", "highlights", "blinks"]
        rows = []
        for p in payloads:
            try:
                found = boxes.timed_text(bytes(p or b""))
                rows.append([found[n] for n in names] + [None])
            except boxes.Bad as e:
                rows.append([None] * len(names) + [str(e)])
        return pd.DataFrame(rows, columns=[*names, "error"], dtype=object)

    return packets.withColumn("sample", parse("payload"))


def text_rows(parsed: DataFrame) -> DataFrame:
    """One row per style record of parsed text samples."""
    return parsed.select("file_id", "packet_index", F.explode_outer("sample.styles").alias("style")).select("file_id", "packet_index", "style.*")


def webvtt_cues(packets: DataFrame) -> DataFrame:
    """``file_id, packet_index, item, kind, source_id, cue_id, cue_time, settings, payload, error``: one row per cue."""

    @F.pandas_udf(CUES)
    def parse(payloads: pd.Series) -> pd.DataFrame:
        rows = []
        for p in payloads:
            try:
                items = [{k: i.get(k) for k in ("kind", "source_id", "cue_id", "cue_time", "settings", "payload")} for i in boxes.webvtt(bytes(p or b""))]
                rows.append((items, None))
            except boxes.Bad as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["items", "error"], dtype=object)

    parsed = packets.select("file_id", "packet_index", parse("payload").alias("s"))
    each = parsed.select("file_id", "packet_index", F.col("s.error").alias("error"), F.posexplode_outer("s.items").alias("item", "c"))
    return each.select("file_id", "packet_index", "item", "c.*", "error")


def skip_samples(side_data: Column) -> Column:
    """The skip-samples entry of a side data list as a struct: two little-endian counts and two reasons; null without one."""
    entry = F.get(F.filter(side_data, lambda s: (s["kind"] == "skip_samples") & (F.octet_length(s["data"]) >= 10)), F.lit(0))["data"]
    text = F.hex(entry)
    number = lambda at: F.conv(F.concat(*[F.substring(text, at + k, 2) for k in (6, 4, 2, 0)]), 16, 10).cast("bigint")
    byte = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    return F.when(entry.isNotNull(), F.struct(number(1).alias("skip_samples"), number(9).alias("discard_padding"), byte(17).alias("skip_reason"), byte(19).alias("discard_reason")))


#: Bytes of encoded text that are decoded before they are put away as an Arrow array.
DECODED_BYTES = 4 << 20


def decode_text(data: Column, wide: Column) -> Column:
    """``struct(text, error)`` of tag bytes: UTF-8, or where ``wide`` UTF-16 by its byte order mark, big-endian without one.

    A batch holds its texts as Arrow arrays; only ``DECODED_BYTES`` of them are Python objects at a time.
    The column is not evaluated anew for each use, so that one that filters by the error decodes once.
    """

    @F.arrow_udf("struct<text:string,error:string>")
    def run(values: pa.Array, wides: pa.Array) -> pa.Array:
        texts, errors, done, held = [], [], [], 0

        def put() -> None:
            done.append(pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"]))
            texts.clear(), errors.clear()

        for v, w in zip(values, wides):
            raw = v.as_py() or b""
            try:
                text, error = boxes.text_of(raw, bool(w.as_py())), None
            except boxes.Bad as e:
                text, error = None, str(e)
            texts.append(text), errors.append(error)
            held += len(raw)
            if held >= DECODED_BYTES:
                put()
                held = 0
        put()
        return pa.concat_arrays(done)

    return run.asNondeterministic()(data, wide)
