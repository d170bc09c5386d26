"""Small dimension tables: sample formats, pixel formats, channel layouts and codec names.

Each is a list of rows in Python and, by ``table``, a DataFrame. Sizes are fixed, so they
may be broadcast.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, rows: list) -> DataFrame:
    """Dataclass rows as a DataFrame with ``ord``, their place in the list."""
    return spark.createDataFrame([{"ord": i, **asdict(r)} for i, r in enumerate(rows)])


@dataclass(frozen=True)
class SampleFormat:
    name: str
    bytes: int
    planar: bool
    kind: str


#: The names in their usual order.
_SAMPLE_NAMES = ("u8", "s16", "s32", "flt", "dbl", "u8p", "s16p", "s32p", "fltp", "dblp", "s64", "s64p")


def _sample_format(name: str) -> SampleFormat:
    base = name.removesuffix("p")
    size = {"flt": 4, "dbl": 8}.get(base) or int(base[1:]) // 8
    return SampleFormat(name, size, base != name, {"u": "unsigned", "s": "signed"}.get(base[0], "float") if base != "flt" and base != "dbl" else "float")


SAMPLE_FORMATS = [_sample_format(n) for n in _SAMPLE_NAMES]

#: Native channels by bit of the mask.
CHANNEL_BITS = {
    "FL": 0, "FR": 1, "FC": 2, "LFE": 3, "BL": 4, "BR": 5, "FLC": 6, "FRC": 7, "BC": 8, "SL": 9, "SR": 10, "TC": 11,
    "TFL": 12, "TFC": 13, "TFR": 14, "TBL": 15, "TBC": 16, "TBR": 17, "DL": 29, "DR": 30, "WL": 31, "WR": 32,
    "SDL": 33, "SDR": 34, "LFE2": 35, "TSL": 36, "TSR": 37, "BFC": 38, "BFL": 39, "BFR": 40, "SSL": 41, "SSR": 42,
    "TTL": 43, "TTR": 44, "BIL": 61, "BIR": 62,
}

#: The known layouts in their usual order.
_LAYOUTS = {
    "mono": "FC",
    "stereo": "FL FR",
    "2.1": "FL FR LFE",
    "3.0": "FL FR FC",
    "3.0(back)": "FL FR BC",
    "4.0": "FL FR FC BC",
    "quad": "FL FR BL BR",
    "quad(side)": "FL FR SL SR",
    "3.1": "FL FR FC LFE",
    "5.0": "FL FR FC BL BR",
    "5.0(side)": "FL FR FC SL SR",
    "4.1": "FL FR FC LFE BC",
    "5.1": "FL FR FC LFE BL BR",
    "5.1(side)": "FL FR FC LFE SL SR",
    "6.0": "FL FR FC BC SL SR",
    "6.0(front)": "FL FR FLC FRC SL SR",
    "3.1.2": "FL FR FC LFE TFL TFR",
    "hexagonal": "FL FR FC BL BR BC",
    "6.1": "FL FR FC LFE BC SL SR",
    "6.1(back)": "FL FR FC LFE BL BR BC",
    "6.1(front)": "FL FR LFE FLC FRC SL SR",
    "7.0": "FL FR FC BL BR SL SR",
    "7.0(front)": "FL FR FC FLC FRC SL SR",
    "7.1": "FL FR FC LFE BL BR SL SR",
    "7.1(wide)": "FL FR FC LFE BL BR FLC FRC",
    "7.1(wide-side)": "FL FR FC LFE FLC FRC SL SR",
    "5.1.2": "FL FR FC LFE SL SR TFL TFR",
    "5.1.2(back)": "FL FR FC LFE BL BR TFL TFR",
    "octagonal": "FL FR FC BL BR BC SL SR",
    "cube": "FL FR BL BR TFL TFR TBL TBR",
    "5.1.4": "FL FR FC LFE SL SR TFL TFR TBL TBR",
    "7.1.2": "FL FR FC LFE BL BR SL SR TFL TFR",
    "7.1.4": "FL FR FC LFE BL BR SL SR TFL TFR TBL TBR",
    "7.2.3": "FL FR FC LFE BL BR SL SR TFL TFR TBC LFE2",
    "9.1.4": "FL FR FC LFE BL BR FLC FRC SL SR TFL TFR TBL TBR",
    "9.1.6": "FL FR FC LFE BL BR FLC FRC SL SR TFL TFR TBL TBR TSL TSR",
    "hexadecagonal": "FL FR FC BL BR BC SL SR TFL TFC TFR TBL TBC TBR WL WR",
    "binaural": "BIL BIR",
    "downmix": "DL DR",
    "22.2": "FL FR FC LFE BL BR FLC FRC BC SL SR TC TFL TFC TFR TBL TBC TBR LFE2 TSL TSR BFC BFL BFR",
}


@dataclass(frozen=True)
class ChannelLayout:
    name: str
    mask: int
    channels: list[str]


CHANNEL_LAYOUTS = [ChannelLayout(n, sum(1 << CHANNEL_BITS[c] for c in x.split()), x.split()) for n, x in _LAYOUTS.items()]


@dataclass(frozen=True)
class PixelFormat:
    """A frame's layout by component and plane.

    ``depths``: bits of each component; ``plane_bytes``: bytes of a group of ``group``
    pixels of a line in each plane (a line has whole groups); planes 1 and 2 of planar YUV
    are smaller by the chroma shifts. A format with ``loose`` lines takes any width. Frames
    that live in devices have no depths and no planes.
    """

    name: str
    color: str  # gray, rgb, yuv, yuvj, xyz or none
    depths: list[int]
    plane_bytes: list[int]
    chroma_w: int = 0
    chroma_h: int = 0
    alpha: bool = False
    group: int = 1
    loose: bool = False
    paletted: bool = False

    @property
    def planar_chroma(self) -> bool:
        """Whether chroma lies in planes of its own."""
        return self.color in ("yuv", "yuvj") and len(self.plane_bytes) > 1


#: Names of frames that live in devices.
HARDWARE = ("vaapi", "dxva2_vld", "vdpau", "qsv", "mmal", "d3d11va_vld", "cuda", "videotoolbox_vld", "mediacodec", "d3d11", "drm_prime", "opencl", "vulkan", "d3d12", "amf", "ohcodec")
#: Chroma shifts by the three digits of a name.
SHIFTS = {"444": (0, 0), "440": (0, 1), "422": (1, 0), "420": (1, 1), "411": (2, 0), "410": (2, 2)}
ENDS = ("le", "be")


def _gray() -> list[PixelFormat]:
    """One value a pixel, or two with alpha; whole numbers, then floating point, then single bits."""
    rows = [PixelFormat("gray", "gray", [8], [1])]
    rows += [PixelFormat(f"gray{d}{e}", "gray", [d], [4 if d > 16 else 2]) for d in (9, 10, 12, 14, 16, 32) for e in ENDS]
    rows += [PixelFormat(f"grayf{d}{e}", "gray", [d], [d // 8]) for d in (16, 32) for e in ENDS]
    rows += [PixelFormat("ya8", "gray", [8] * 2, [2], alpha=True), *(PixelFormat(f"{n}{d}{e}", "gray", [d] * 2, [d // 4], alpha=True) for n, d in (("ya", 16), ("yaf", 16), ("yaf", 32)) for e in ENDS)]
    return rows + [PixelFormat(n, "gray", [1], [1], group=8, loose=True) for n in ("monow", "monob")]


def _rgb() -> list[PixelFormat]:
    """Packed, low-depth, Bayer and planar RGB, and the palette."""
    rows = [PixelFormat(n, "rgb", [8] * 3, [3]) for n in ("rgb24", "bgr24")]
    rows += [PixelFormat(n, "rgb", [8] * 4, [4], alpha=True) for n in ("rgba", "bgra", "argb", "abgr")]
    rows += [PixelFormat(n, "rgb", [8] * 3, [4]) for n in ("rgb0", "bgr0", "0rgb", "0bgr")]
    for n in ("rgb", "bgr"):
        rows += [PixelFormat(f"{n}8", "rgb", [3, 3, 2], [1]), PixelFormat(f"{n}4_byte", "rgb", [1, 2, 1], [1]), PixelFormat(f"{n}4", "rgb", [1, 2, 1], [1], group=2, loose=True)]
        rows += [PixelFormat(f"{n}{d}{e}", "rgb", depths, [2]) for d, depths in (("565", [5, 6, 5]), ("555", [5] * 3), ("444", [4] * 3)) for e in ENDS]
        rows += [PixelFormat(f"{n}48{e}", "rgb", [16] * 3, [6]) for e in ENDS] + [PixelFormat(f"{n}a64{e}", "rgb", [16] * 4, [8], alpha=True) for e in ENDS]
        rows += [PixelFormat(f"x2{n}10{e}", "rgb", [10] * 3, [4]) for e in ENDS]
    rows += [PixelFormat(f"rgb96{e}", "rgb", [32] * 3, [12]) for e in ENDS] + [PixelFormat(f"rgba128{e}", "rgb", [32] * 4, [16], alpha=True) for e in ENDS]
    rows += [PixelFormat(f"rgb{a}f{d}{e}", "rgb", [d] * k, [d // 8 * k], alpha=k == 4) for a, k in (("", 3), ("a", 4)) for d in (16, 32) for e in ENDS]
    for order in ("bggr", "rggb", "gbrg", "grbg"):
        rows += [PixelFormat(f"bayer_{order}8", "rgb", [2, 4, 2], [1]), *(PixelFormat(f"bayer_{order}16{e}", "rgb", [4, 8, 4], [2]) for e in ENDS)]
    for a, k in (("", 3), ("a", 4)):
        rows.append(PixelFormat(f"gbr{a}p", "rgb", [8] * k, [1] * k, alpha=k == 4))
        rows += [PixelFormat(f"gbr{a}p{d}{e}", "rgb", [d] * k, [4 if d > 16 else 2] * k, alpha=k == 4) for d in ((9, 10, 12, 14, 16) if k == 3 else (10, 12, 14, 16, 32)) for e in ENDS]
        rows += [PixelFormat(f"gbr{a}pf{d}{e}", "rgb", [d] * k, [d // 8] * k, alpha=k == 4) for d in (16, 32) for e in ENDS]
    rows += [PixelFormat(f"gbrp{d}msb{e}", "rgb", [d] * 3, [2] * 3) for d in (10, 12) for e in ENDS]
    return [*rows, PixelFormat("pal8", "rgb", [8], [1], alpha=True, paletted=True)]


def _yuv() -> list[PixelFormat]:
    """Planar, half-planar and packed YUV, and XYZ."""
    planar = lambda n, d, s, k, color="yuv": PixelFormat(n, color, [d] * k, [2 if d > 8 else 1] * k, *SHIFTS[s], k == 4)
    rows = [planar(f"yuv{s}p", 8, s, 3) for s in SHIFTS] + [planar(f"yuvj{s}p", 8, s, 3, "yuvj") for s in ("411", "420", "422", "440", "444")]
    rows += [planar(f"yuv{s}p{d}{e}", d, s, 3) for s in ("420", "422", "444") for d in (9, 10, 12, 14, 16) for e in ENDS]
    rows += [planar(f"yuv440p{d}{e}", d, "440", 3) for d in (10, 12) for e in ENDS] + [planar(f"yuv444p{d}msb{e}", d, "444", 3) for d in (10, 12) for e in ENDS]
    rows += [planar(f"yuva{s}p", 8, s, 4) for s in ("420", "422", "444")]
    rows += [planar(f"yuva{s}p{d}{e}", d, s, 4) for s in ("420", "422", "444") for d in (9, 10, 12, 16) if (s, d) != ("420", 12) for e in ENDS]
    half = lambda n, d, s: PixelFormat(n, "yuv", [d] * 3, [1, 2] if d == 8 else [2, 4], *SHIFTS[s])
    rows += [half(n, 8, s) for n, s in (("nv12", "420"), ("nv21", "420"), ("nv16", "422"), ("nv24", "444"), ("nv42", "444"))] + [half(f"nv20{e}", 10, "422") for e in ENDS]
    rows += [half(f"p{k}{d}{e}", d, s) for k, s in (("0", "420"), ("2", "422"), ("4", "444")) for d in (10, 12, 16) for e in ENDS]
    rows += [PixelFormat(n, "yuv", [8] * 3, [2], 1) for n in ("yuyv422", "uyvy422", "yvyu422")] + [PixelFormat("uyyvyy411", "yuv", [8] * 3, [6], 2, group=4, loose=True)]
    rows += [PixelFormat(f"y2{d}{e}", "yuv", [d] * 3, [4], 1) for d in (10, 12, 16) for e in ENDS]
    rows += [PixelFormat(f"{n}{e}", "yuv", [d] * 3, [b]) for n, d, b in (("xv30", 10, 4), ("v30x", 10, 4), ("xv36", 12, 8), ("xv48", 16, 8)) for e in ENDS]
    rows += [PixelFormat(n, "yuv", [8] * 4, [4], alpha=True) for n in ("vuya", "ayuv", "uyva")] + [PixelFormat("vuyx", "yuv", [8] * 3, [4]), PixelFormat("vyu444", "yuv", [8] * 3, [3])]
    rows += [PixelFormat(f"ayuv64{e}", "yuv", [16] * 4, [8], alpha=True) for e in ENDS]
    return rows + [PixelFormat(f"xyz12{e}", "xyz", [12] * 3, [6]) for e in ENDS]


def _pixel_formats() -> list[PixelFormat]:
    """All formats, from rules for their families."""
    return [*_gray(), *_rgb(), *_yuv(), *(PixelFormat(n, "none", [], []) for n in HARDWARE)]


PIXEL_FORMATS = _pixel_formats()

#: Codec names by four-character code.
CODECS = {
    "\0\0\0\0": ("rawvideo", "raw video"),
    "DIB ": ("rawvideo", "raw video"),
    "raw ": ("rawvideo", "raw video"),
    "avc1": ("h264", "H.264 / AVC / MPEG-4 AVC / MPEG-4 part 10"),
    "avc3": ("h264", "H.264 / AVC / MPEG-4 AVC / MPEG-4 part 10"),
    "hvc1": ("hevc", "H.265 / HEVC (High Efficiency Video Coding)"),
    "hev1": ("hevc", "H.265 / HEVC (High Efficiency Video Coding)"),
    "mp4v": ("mpeg4", "MPEG-4 part 2"),
    "mp4a": ("aac", "AAC (Advanced Audio Coding)"),
    "sowt": ("pcm_s16le", "PCM signed 16-bit little-endian"),
    "twos": ("pcm_s16be", "PCM signed 16-bit big-endian"),
}

#: Stream types by handler.
HANDLERS = {"vide": "video", "soun": "audio", "subt": "subtitle", "sbtl": "subtitle", "text": "subtitle", "clcp": "subtitle", "meta": "data", "hint": "data"}

#: Profile and colour names by code.
AVC_PROFILES = {44: "CAVLC 4:4:4", 66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4 Predictive"}
HEVC_PROFILES = {1: "Main", 2: "Main 10", 3: "Main Still Picture", 4: "Range Extension"}
COLOR_SPACES = {1: "bt709", 4: "fcc", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "ycgco", 9: "bt2020nc", 10: "bt2020c", 11: "smpte2085", 12: "chroma-derived-nc", 13: "chroma-derived-c", 14: "ictcp"}
COLOR_TRANSFERS = {
    1: "bt709", 4: "gamma22", 5: "gamma28", 6: "smpte170m", 7: "smpte240m", 8: "linear", 9: "log", 10: "log_sqrt", 11: "iec61966-2-4", 12: "bt1361e",
    13: "iec61966-2-1", 14: "bt2020-10", 15: "bt2020-12", 16: "smpte2084", 17: "smpte428", 18: "arib-std-b67",
}
COLOR_PRIMARIES = {1: "bt709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "film", 9: "bt2020", 10: "smpte428", 11: "smpte431", 12: "smpte432", 22: "ebu3213"}
