"""Byte layouts of containers: small parsers over one file's bytes, for vectorised helpers.

``data`` is a file's bytes, or what reads them by range (``ranged.Ranged``); parsers take
headers and tables by slices, and leave payloads alone where they are told so. Lengths in files lie, so every read is checked against its bounds; what doesn't fit raises
``Bad``, which becomes an error row and never fails a job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator


class Bad(Exception):
    """Broken input: a kind and a message."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def need(data: bytes, at: int, n: int, what: str, end: int | None = None) -> bytes:
    if at < 0 or n < 0 or at + n > (len(data) if end is None else min(end, len(data))):
        raise Bad("EndOfFile", f"{what} is truncated")
    return data[at : at + n]


def unpack(layout: str, data: bytes, at: int = 0) -> tuple:
    """Numbers at a place; only the bytes they take are read."""
    return struct.unpack(layout, data[at : at + struct.calcsize(layout)])


# --- RIFF


def riff_chunks(data: bytes, at: int, end: int, what: str) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, end) of chunks; odd ones are padded."""
    while at < end:
        if end - at < 8:
            raise Bad("EndOfFile", f"{what} chunk header is truncated")
        name, n = unpack("<4sI", data, at)
        if at + 8 + n > end:
            raise Bad("EndOfFile", f"{what} chunk exceeds its bounds")
        yield name, at + 8, at + 8 + n
        at += 8 + n + (n & 1 if at + 8 + n < end else 0)


def riff(data: bytes, form: bytes) -> int:
    """The end of the RIFF payload."""
    head = need(data, 0, 12, "RIFF header")
    if head[:4] != b"RIFF" or head[8:] != form:
        raise Bad("InvalidData", f"not a RIFF file of form {form.decode()}")
    end = 8 + unpack("<I", head, 4)[0]
    if end < 12:
        raise Bad("InvalidData", "RIFF size is too small")
    if end > len(data):
        raise Bad("EndOfFile", "RIFF size exceeds the input")
    return end


#: Fixed value: the sub-format of extensible headers that means plain PCM.
PCM_GUID = bytes.fromhex("0100000000001000800000aa00389b71")


def wav(data: bytes, payloads: bool = True) -> dict:
    """First ``fmt ``, last ``data``; 16-bit PCM, extensible headers included."""
    end, fmt, body = riff(data, b"WAVE"), None, None
    for name, a, b in riff_chunks(data, 12, end, "WAV"):
        if name == b"fmt " and fmt is None:
            fmt = data[a:b]
            if len(fmt) < 16:
                raise Bad("EndOfFile", "fmt chunk is shorter than 16 bytes")
            if (tag := unpack("<H", fmt)[0]) == 0xFFFE:
                if len(fmt) < 40 or unpack("<H", fmt, 16)[0] < 22:
                    raise Bad("InvalidData", "extensible fmt chunk is too short")
                if fmt[24:40] != PCM_GUID:
                    raise Bad("Unsupported", "unsupported extensible sub-format")
            elif tag != 1:
                raise Bad("Unsupported", f"unsupported audio format {tag}")
        elif name == b"data":
            body = (a, b)
    if fmt is None or body is None:
        raise Bad("InvalidData", "missing fmt or data chunk")
    channels, rate, byte_rate, align, bits = unpack("<HIIHH", fmt, 2)
    return {"channels": channels, "sample_rate": rate, "byte_rate": byte_rate, "block_align": align, "bits_per_sample": bits, "pos": body[0], "size": body[1] - body[0], "payload": data[body[0] : body[1]] if payloads else None}


def wav_error(info: dict) -> str | None:
    """What is wrong with the declared numbers of a 16-bit PCM header."""
    if not info["channels"] or not info["sample_rate"]:
        return "channels and sample rate must be positive"
    if info["bits_per_sample"] != 16:
        return f"unsupported bits per sample {info['bits_per_sample']}"
    if info["block_align"] != 2 * info["channels"]:
        return f"block align {info['block_align']} does not match {2 * info['channels']}"
    if info["byte_rate"] != info["sample_rate"] * info["block_align"]:
        return f"byte rate {info['byte_rate']} does not match {info['sample_rate'] * info['block_align']}"
    return None


def avi(data: bytes, payloads: bool = True) -> dict:
    """Headers and packets, without payloads as they are walked; of repeated lists the last counts."""
    end, header, streams, movi = riff(data, b"AVI "), None, [], None
    for name, a, b in riff_chunks(data, 12, end, "AVI"):
        if name == b"LIST":
            kind = need(data, a, 4, "list type", b)
            if kind == b"hdrl":
                header, streams = _avi_headers(data, a + 4, b)
            elif kind == b"movi":
                movi = (a + 4, b)
    if header is None or not streams:
        raise Bad("InvalidData", "missing headers")
    if header["streams"] != len(streams):
        raise Bad("InvalidData", f"{header['streams']} streams are declared but {len(streams)} were found")
    if movi is None:
        raise Bad("InvalidData", "missing movi list")
    found = _avi_packets(data, *movi, len(streams), payloads)
    return {"header": header, "streams": streams, "packets": list(found) if payloads else found}


def _avi_headers(data: bytes, at: int, end: int) -> tuple[dict | None, list[dict]]:
    header, streams = None, []
    for name, a, b in riff_chunks(data, at, end, "hdrl"):
        if name == b"avih":
            if b - a < 56:
                raise Bad("EndOfFile", "avih is shorter than 56 bytes")
            v = unpack("<14I", data, a)
            if not v[6] or not v[8] or not v[9]:
                raise Bad("InvalidData", "stream count and dimensions must not be 0")
            header = {"microseconds_per_frame": v[0], "max_bytes_per_second": v[1], "total_frames": v[4], "streams": v[6], "width": v[8], "height": v[9]}
        elif name == b"LIST" and data[a : a + 4] == b"strl":
            streams.append(_avi_stream(data, a + 4, b))
    return header, streams


def _avi_stream(data: bytes, at: int, end: int) -> dict:
    out: dict = {}
    for name, a, b in riff_chunks(data, at, end, "strl"):
        if name == b"strh":
            if b - a < 56:
                raise Bad("EndOfFile", "strh is shorter than 56 bytes")
            if data[a : a + 4] != b"vids":
                raise Bad("Unsupported", f"unsupported stream type {data[a : a + 4]!r}")
            scale, rate, _, length = unpack("<4I", data, a + 20)
            out |= {"handler": data[a + 4 : a + 8].decode("latin-1"), "scale": scale, "rate": rate, "length": length}
        elif name == b"strf":
            if b - a < 40:
                raise Bad("EndOfFile", "strf is shorter than 40 bytes")
            size, width, height, planes, bits, compression = unpack("<IiiHH4s", data, a)
            if size < 40 or planes != 1:
                raise Bad("InvalidData", "bad bitmap header")
            if width <= 0 or height == 0:
                raise Bad("Unsupported", "width must be positive and height not 0")
            out |= {"width": width, "height": abs(height), "bit_count": bits, "compression": compression.decode("latin-1")}
    if "scale" not in out or "width" not in out:
        raise Bad("InvalidData", "stream without strh or strf")
    if not out["scale"] or not out["rate"]:
        raise Bad("InvalidData", "rate and scale must not be 0")
    return out


def _avi_packets(data: bytes, at: int, end: int, streams: int, payloads: bool) -> Iterator[dict]:
    for name, a, b in riff_chunks(data, at, end, "movi"):
        if name == b"LIST":
            if data[a : a + 4] == b"rec ":
                yield from _avi_packets(data, a + 4, b, streams, payloads)
        elif name[:2].isdigit() and name[2:] in (b"db", b"dc", b"wb"):
            if int(name[:2]) >= streams:
                raise Bad("InvalidData", f"packet of unknown stream {int(name[:2])}")
            if name[2:] == b"wb":
                raise Bad("Unsupported", f"unsupported chunk {name!r}")
            yield {"stream_index": int(name[:2]), "pos": a, "size": b - a, "payload": data[a:b] if payloads else None, "chunk_id": name}


def y4m(data: bytes, payloads: bool = True) -> dict:
    """Header and frames, each with its place and, if asked for, its payload; ``tail`` are the bytes behind the last whole frame. A short last frame is dropped; blank lines before the first frame are skipped."""
    at = data.find(b"\n")
    if at < 0:
        raise Bad("EndOfFile", "header line is truncated")
    magic, *parts = data[:at].decode("latin-1").split(" ")
    if magic != "YUV4MPEG2":
        raise Bad("InvalidData", "header lacks its magic")
    info: dict = {"sar": None, "color_range": None}
    for p in filter(None, parts):
        tag, value = p[0], p[1:]
        if not value:
            if tag in "XA":
                continue
            raise Bad("InvalidData", f"header field {p} has no value")
        if tag in "WH":
            if not value.isdigit() or not int(value):
                raise Bad("InvalidData", f"bad dimension {value}")
            info["width" if tag == "W" else "height"] = int(value)
        elif tag == "F":
            n, _, d = value.partition(":")
            if not (n.isdigit() and d.isdigit() and int(n) and int(d)):
                raise Bad("InvalidData", f"bad rate {value}")
            info["rate"] = (int(n), int(d))
        elif tag == "A":
            info["sar"] = None if value.startswith("0:") else value
        elif tag == "X":
            info["color_range"] = {"COLORRANGE=FULL": "pc", "COLORRANGE=LIMITED": "tv"}.get(value, info["color_range"])
        elif tag == "I" and value != "p" or tag == "C" and value != "420jpeg" or tag not in "IC":
            raise Bad("Unsupported", f"unsupported header field {p}")
    if not {"width", "height", "rate"} <= info.keys():
        raise Bad("InvalidData", "width, height or rate is missing")
    if info["width"] % 2 or info["height"] % 2:
        raise Bad("Unsupported", "4:2:0 needs even dimensions")
    size, at, frames = info["width"] * info["height"] * 3 // 2, at + 1, []
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            if not frames:
                break
            raise Bad("EndOfFile", "frame header is truncated")
        line = data[at:end]
        if not frames and not line.strip():
            at = end + 1
            continue
        if not line.startswith(b"FRAME"):
            if not frames:
                break
            raise Bad("InvalidData", "frame header lacks FRAME")
        if end + 1 + size > len(data):
            break
        frames.append((end + 1, data[end + 1 : end + 1 + size] if payloads else None))
        at = end + 1 + size
    return {**info, "frames": frames, "frame_bytes": size, "tail": len(data) - at}


# --- MOV boxes

#: Boxes that hold boxes, and how many bytes come before these.
PARENTS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"dinf": 0, b"meta": 4, b"ilst": 0}


def boxes(data: bytes, at: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, bytes, int, int]]:
    """(path, type, start, end) of boxes in depth-first order; start is behind the header."""
    end = len(data) if end is None else end
    count: dict[bytes, int] = {}
    while at < end:
        if end - at < 8:
            raise Bad("EndOfFile", "box header is truncated")
        size, kind = unpack(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Bad("EndOfFile", "box header is truncated")
            size, head = unpack(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Bad("InvalidData", "box exceeds its parent")
        n = count[kind] = count.get(kind, -1) + 1
        here = f"{path}/{kind.decode('latin-1')}[{n}]"
        yield here, kind, at + head, at + size
        if kind in PARENTS:
            skip = PARENTS[kind]
            if kind == b"meta" and data[at + head + 4 : at + head + 8] == b"hdlr":
                skip = 0
            yield from boxes(data, min(at + head + skip, at + size), at + size, here)
        elif path.endswith("/ilst[0]"):
            yield from boxes(data, at + head, at + size, here)
        at += size


def _table(data: bytes, a: int, b: int, width: str, head: int = 8) -> list[tuple]:
    n = struct.unpack(">I", need(data, a + head - 4, 4, "table", b))[0]
    size = struct.calcsize(">" + width)
    return list(struct.iter_unpack(">" + width, need(data, a + head, n * size, "table", b)))


def _time(data: bytes, a: int, b: int) -> tuple[int, int | None]:
    """Timescale and duration of mvhd or mdhd; all ones mean unknown."""
    wide = need(data, a, 1, "header", b)[0] == 1
    scale, length = struct.unpack(">IQ" if wide else ">II", need(data, a + (20 if wide else 12), 12 if wide else 8, "header", b))
    return scale, None if length == (1 << (64 if wide else 32)) - 1 else length


def mov(data: bytes) -> dict:
    """Movie, tracks with raw sample tables, media ranges and tag items. Of repeated boxes the last counts."""
    out: dict = {"timescale": None, "duration": None, "tracks": [], "mdat": [], "brand": None}
    track: dict | None = None
    for path, kind, a, b in boxes(data):
        if kind == b"ftyp" and b - a >= 4:
            out["brand"] = data[a : a + 4].decode("latin-1")
        elif kind == b"mdat":
            out["mdat"].append((a, b))
        elif kind == b"mvhd":
            out["timescale"], out["duration"] = _time(data, a, b)
        elif kind == b"trak":
            track = {"index": len(out["tracks"])}
            out["tracks"].append(track)
        elif track is not None and "/trak[" in path:
            _track_box(track, data, kind, a, b)
    if not out["tracks"]:
        raise Bad("InvalidData", "no track")
    return out


def _track_box(track: dict, data: bytes, kind: bytes, a: int, b: int) -> None:
    if kind == b"tkhd":
        wide = need(data, a, 1, "tkhd", b)[0] == 1
        track["id"] = struct.unpack(">I", need(data, a + (20 if wide else 12), 4, "tkhd", b))[0]
        w, h = struct.unpack(">II", need(data, b - 8, 8, "tkhd", b))
        track["width"], track["height"] = (w >> 16) or None, (h >> 16) or None
    elif kind == b"mdhd":
        track["timescale"], track["duration"] = _time(data, a, b)
        wide = need(data, a, 1, "mdhd", b)[0] == 1
        track["language"] = struct.unpack(">H", need(data, a + (32 if wide else 20), 2, "mdhd", b))[0]
    elif kind == b"hdlr" and "handler" not in track:
        track["handler"] = need(data, a + 8, 4, "hdlr", b).decode("latin-1")
        track["handler_name"] = data[a + 24 : b].split(b"\0")[0].decode("utf-8", "replace")
    elif kind == b"elst":
        wide = need(data, a, 1, "elst", b)[0] == 1
        track["elst"] = [x[1] for x in _table(data, a, b, "QqI" if wide else "IiI")]
    elif kind == b"stsd":
        track["stsd"] = data[a:b]
    elif kind in (b"stts", b"ctts"):
        signed = kind == b"ctts" and need(data, a, 1, "ctts", b)[0] == 1
        track[kind.decode()] = _table(data, a, b, "Ii" if signed else "II")
    elif kind == b"stsc":
        track["stsc"] = _table(data, a, b, "III")
    elif kind == b"stsz":
        size, n = struct.unpack(">II", need(data, a + 4, 8, "stsz", b))
        track["stsz"] = [(n, size)] if size else [(1, x[0]) for x in _table(data, a, b, "I", 12)]
    elif kind in (b"stco", b"co64"):
        track["stco"] = [x[0] for x in _table(data, a, b, "I" if kind == b"stco" else "Q")]
    elif kind == b"stss":
        track["stss"] = [x[0] for x in _table(data, a, b, "I")]


def sample_entry(stsd: bytes) -> dict:
    """What the first sample entry tells: its code, dimensions, audio numbers, codec configuration, aspect and colour."""
    out: dict = {}
    size, fourcc = struct.unpack(">I4s", need(stsd, 8, 8, "sample entry"))
    entry = need(stsd, 8, size, "sample entry")
    out["fourcc"] = fourcc.decode("latin-1")
    kids = None
    if fourcc in (b"avc1", b"avc3", b"hvc1", b"hev1", b"mp4v", b"raw ", b"DIB ", b"\0\0\0\0") and len(entry) >= 86:
        out["kind"] = "video"
        out["width"], out["height"] = struct.unpack_from(">HH", entry, 32)
        out["depth"] = struct.unpack_from(">H", entry, 82)[0]
        kids = 86
    elif fourcc in (b"mp4a", b"sowt", b"twos", b"alac", b"fLaC") and len(entry) >= 36:
        out["kind"] = "audio"
        version, = struct.unpack_from(">H", entry, 16)
        out["channels"], out["bits_per_sample"] = struct.unpack_from(">HH", entry, 24)
        out["sample_rate"] = struct.unpack_from(">I", entry, 32)[0] >> 16
        kids = 36 + {1: 16, 2: 36}.get(version, 0)
        if version == 2 and len(entry) >= 72:
            out["sample_rate"] = int(struct.unpack_from(">d", entry, 40)[0])
            out["channels"] = struct.unpack_from(">I", entry, 48)[0]
            out["bits_per_sample"] = struct.unpack_from(">I", entry, 56)[0]
    elif fourcc in (b"tx3g", b"wvtt"):
        out["kind"] = "subtitle"
    if kids is not None:
        for _, kind, a, b in boxes(entry, min(kids, len(entry))):
            _entry_box(out, entry, kind, a, b)
    return out


def _entry_box(out: dict, e: bytes, kind: bytes, a: int, b: int) -> None:
    n = b - a
    if kind == b"avcC" and n >= 5:
        out |= {"profile": e[a + 1], "level": e[a + 3], "nal_length_size": (e[a + 4] & 3) + 1, "is_avc": True, "extradata_size": n}
    elif kind == b"hvcC" and n >= 22:
        out |= {"profile": e[a + 1] & 31, "level": e[a + 12], "nal_length_size": (e[a + 21] & 3) + 1, "extradata_size": n}
    elif kind == b"pasp" and n >= 8:
        out["h_spacing"], out["v_spacing"] = struct.unpack_from(">II", e, a)
    elif kind == b"colr" and n >= 10 and e[a : a + 4] in (b"nclx", b"nclc"):
        out["primaries"], out["transfer"], out["matrix"] = struct.unpack_from(">HHH", e, a + 4)
        if e[a : a + 4] == b"nclx" and n >= 11:
            out["full_range"] = bool(e[a + 10] & 0x80)
    elif kind == b"alac" and n >= 28:
        out["bits_per_raw_sample"], out["channels"] = e[a + 9], e[a + 13]
        out["sample_rate"] = struct.unpack_from(">I", e, a + 24)[0]
    elif kind == b"dfLa" and n >= 42:
        packed = int.from_bytes(e[a + 18 : a + 26], "big")
        out["sample_rate"], out["channels"], out["bits_per_raw_sample"] = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1


# --- MOV tags and cover art

#: Tag names and value kinds of metadata atoms.
ATOMS = {
    b"\xa9nam": ("title", "text"),
    b"\xa9ART": ("artist", "text"),
    b"aART": ("album_artist", "text"),
    b"\xa9alb": ("album", "text"),
    b"\xa9day": ("date", "text"),
    b"\xa9gen": ("genre", "text"),
    b"\xa9cmt": ("comment", "text"),
    b"desc": ("description", "text"),
    b"ldes": ("long_description", "text"),
    b"\xa9too": ("encoder", "text"),
    b"akID": ("account_type", "int8"),
    b"cpil": ("compilation", "int8"),
    b"egid": ("episode_uid", "int8"),
    b"gnre": ("genre", "genre"),
    b"hdvd": ("hd_video", "int8"),
    b"pcst": ("podcast", "int8"),
    b"pgap": ("gapless_playback", "int8"),
    b"rtng": ("rating", "int8"),
    b"stik": ("media_type", "int8"),
    b"trkn": ("track", "pair"),
    b"tves": ("episode_sort", "int8_padded"),
    b"tvsn": ("season_number", "int8_padded"),
    b"disk": ("disc", "pair"),
}

#: The first names of the ID3v1 genre list, by index.
GENRES = (
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal", "New Age", "Oldies", "Other", "Pop", "R&B", "Rap", "Reggae",
    "Rock", "Techno", "Industrial", "Alternative", "Ska", "Death Metal", "Pranks", "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk", "Fusion",
    "Trance", "Classical", "Instrumental", "Acid", "House", "Game", "Sound Clip", "Gospel", "Noise", "Alternative Rock", "Bass", "Soul", "Punk", "Space", "Meditative",
    "Instrumental Pop", "Instrumental Rock", "Ethnic", "Gothic", "Darkwave", "Techno-Industrial", "Electronic", "Pop-Folk", "Eurodance", "Dream", "Southern Rock",
    "Comedy", "Cult", "Gangsta", "Top 40", "Christian Rap", "Pop/Funk", "Jungle", "Native US", "Cabaret", "New Wave", "Psychedelic", "Rave", "Showtunes", "Trailer",
    "Lo-Fi", "Tribal", "Acid Punk", "Acid Jazz", "Polka", "Retro", "Musical", "Rock & Roll", "Hard Rock",
)
PNG = b"\x89PNG\r\n\x1a\n"


def text_of(data: bytes, wide: bool | None = None) -> str:
    """UTF-8, or UTF-16 if ``wide`` (big-endian without a mark); for None a byte order mark decides."""
    mark = {b"\xfe\xff": "utf-16-be", b"\xff\xfe": "utf-16-le"}.get(data[:2])
    try:
        if wide or wide is None and mark:
            body = data[2:] if mark else data
            if len(data) % 2:
                raise Bad("InvalidData", "UTF-16 text of odd length")
            return body.decode(mark or "utf-16-be")
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise Bad("InvalidData", "text is not valid") from None


def tag_value(kind: str, data_type: int, value: bytes) -> str | None:
    """A metadata value as text; null for what is unset or of another type."""
    if kind == "text":
        return text_of(value, data_type == 2) if data_type in (1, 2) else None
    if kind == "pair":
        if data_type:
            return None
        n, total = struct.unpack(">HH", need(value, 2, 4, "number pair"))
        return None if not n and not total else f"{n}/{total}" if total else str(n)
    if kind == "genre":
        if data_type:
            return None
        if len(value) != 2:
            raise Bad("InvalidData", "bad genre index")
        n = int.from_bytes(value, "big")
        if n > len(GENRES):
            raise Bad("InvalidData", f"unknown genre index {n}")
        return GENRES[n - 1] if n else None
    return str(need(value, 3 if kind == "int8_padded" else 0, 1, "number")[0])


def ilst_items(data: bytes) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str, bytes]]]:
    """Tags as (owner, key, value) in file order, and cover art as (owner, codec, mime, bytes). The owner is the track's path or empty."""
    tags: list[tuple[str, str, str]] = []
    art: list[tuple[str, str, str, bytes]] = []
    free: dict[str, dict[bytes, bytes]] = {}
    for path, kind, a, b in boxes(data):
        parts = path.split("/")
        if "ilst[0]" not in parts:
            continue
        owner = next((p for p in parts if p.startswith("trak[")), "")
        depth = len(parts) - parts.index("ilst[0]")
        if depth == 2 and kind == b"----":
            free[path] = {}
        elif depth == 3 and (item := path.rpartition("/")[0]) in free:
            free[item][kind] = data[a:b]
            if kind == b"data" and {b"mean", b"name"} <= free[item].keys():
                mean, name = (text_of(need(free[item][k], 4, len(free[item][k]) - 4, "text"), False) for k in (b"mean", b"name"))
                if mean and name and name != "cdec":
                    tags.append((owner, name, text_of(need(data, a + 8, b - a - 8, "value", b), False)))
        elif depth == 3 and kind == b"data":
            atom = parts[-2].rpartition("[")[0].encode("latin-1")
            body = need(data, a, 8, "metadata value", b)
            data_type, value = int.from_bytes(body[1:4], "big"), data[a + 8 : b]
            if atom == b"covr":
                declared = {13: ("mjpeg", "image/jpeg"), 14: ("png", "image/png"), 27: ("bmp", "image/bmp")}.get(data_type)
                if declared and data_type != 27 and len(value) >= len(PNG):
                    declared = ("png", "image/png") if value.startswith(PNG) else ("mjpeg", "image/jpeg")
                if declared:
                    art.append((owner, *declared, value))
            elif atom in ATOMS and (text := tag_value(ATOMS[atom][1], data_type, value)) is not None:
                tags.append((owner, ATOMS[atom][0], text))
    return tags, art


# --- text samples


def _children(data: bytes, at: int) -> list[tuple[bytes, bytes]]:
    return [(kind, data[a:b]) for path, kind, a, b in boxes(data, at) if path.count("/") == 1]


def _ranges(kids: list[tuple[bytes, bytes]], kind: bytes, n: int) -> list[tuple[int, int]]:
    found = [struct.unpack(">HH", need(body, 0, 4, "range")) for k, body in kids if k == kind]
    if any(s > e or e > n for s, e in found) or any(b[0] < a[1] for a, b in zip(found, found[1:])):
        raise Bad("InvalidData", f"bad {kind.decode()} ranges")
    return found


def timed_text(data: bytes) -> dict:
    """A tx3g sample: text and encoding, styles, highlights, blinks, links, karaoke, and counts."""
    n = int.from_bytes(need(data, 0, 2, "text length"), "big")
    raw = need(data, 2, n, "text")
    encoding = {b"\xfe\xff": "utf-16be", b"\xff\xfe": "utf-16le"}.get(raw[:2], "utf-8")
    text = text_of(raw)
    kids = _children(data, 2 + n)
    styles = []
    for kind, body in kids:
        if kind == b"styl":
            count = int.from_bytes(need(body, 0, 2, "styl"), "big")
            if len(body) != 2 + 12 * count:
                raise Bad("InvalidData", "bad styl size")
            for start, end, font, face, size, color in struct.iter_unpack(">HHHBB4s", body[2:]):
                if end < start or end > len(text) or (styles and start < styles[-1]["end"] and start < end):
                    raise Bad("InvalidData", "bad styl record")
                styles.append({"start": start, "end": end, "font": font, "face": face, "size": size, "color": color.hex()})
    links = []
    for kind, body in kids:
        if kind == b"href":
            start, end = struct.unpack(">HH", need(body, 0, 4, "href"))
            url_n = need(body, 4, 1, "href")[0]
            url = need(body, 5, url_n, "href").decode("utf-8", "replace")
            alt_n = need(body, 5 + url_n, 1, "href")[0]
            links.append({"start": start, "end": end, "url": url, "alt": need(body, 6 + url_n, alt_n, "href").decode("utf-8", "replace")})
    karaoke = []
    for kind, body in kids:
        if kind == b"krok":
            begin, count = struct.unpack(">IH", need(body, 0, 6, "krok"))
            for end_time, start, end in struct.iter_unpack(">IHH", need(body, 6, 8 * count, "krok")):
                karaoke.append({"start_time": begin, "end_time": end_time, "start": start, "end": end})
                begin = end_time
    return {"text": text, "encoding": encoding, "chars": len(text), "modifiers": len(kids), "styles": styles, "links": links, "karaoke": karaoke, "highlights": [{"start": s, "end": e} for s, e in _ranges(kids, b"hlit", len(text))], "blinks": [{"start": s, "end": e} for s, e in _ranges(kids, b"blnk", len(text))]}


def webvtt(data: bytes) -> list[dict]:
    """A wvtt sample as items: one empty cue, or cues and additional text in order."""
    if not data:
        raise Bad("InvalidData", "empty sample")
    items = []
    for kind, body in _children(data, 0):
        if kind == b"vtte":
            if body:
                raise Bad("InvalidData", "vtte must be empty")
            items.append({"kind": "empty"})
        elif kind == b"vtta":
            items.append({"kind": "additional", "payload": _line(body)})
        elif kind == b"vttc":
            items.append(_cue(body))
        else:
            raise Bad("InvalidData", f"unsupported box {kind!r}")
    kinds = [i["kind"] for i in items]
    if "empty" in kinds and len(items) != 1 or "empty" not in kinds and "cue" not in kinds:
        raise Bad("InvalidData", "a sample is one empty cue or has a cue")
    return items


def _line(body: bytes) -> str:
    text = text_of(body, False)
    if text.endswith(("\n", "\r")):
        raise Bad("InvalidData", "text ends with a line end")
    return text


def _cue(body: bytes) -> dict:
    kids = _children(body, 0)
    names = [k for k, _ in kids]
    if len(set(names)) != len(names) or not set(names) <= {b"vsid", b"iden", b"ctim", b"sttg", b"payl"} or b"payl" not in names:
        raise Bad("InvalidData", "bad boxes in a cue")
    found = dict(kids)
    if b"vsid" in found and len(found[b"vsid"]) != 4:
        raise Bad("InvalidData", "bad source id")
    text = {k: _line(found[k]) for k in (b"iden", b"ctim", b"sttg", b"payl") if k in found}
    if text.get(b"sttg", "").startswith(" ") or "\n\n" in text[b"payl"].replace("\r\n", "\n").replace("\r", "\n"):
        raise Bad("InvalidData", "bad settings or a blank line in a cue")
    source = int.from_bytes(found[b"vsid"], "big") if b"vsid" in found else None
    return {"kind": "cue", "source_id": source, "cue_id": text.get(b"iden"), "cue_time": text.get(b"ctim"), "settings": text.get(b"sttg"), "payload": text[b"payl"]}
