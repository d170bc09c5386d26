"""A small MOV writer: boxes and tracks for the streaming writer, and whole files of one track for round trips and tests."""

from __future__ import annotations

import struct


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, bytes([version]) + flags.to_bytes(3, "big"), *parts)


def runs(values: list[int]) -> list[tuple[int, int]]:
    """Run lengths (count, value)."""
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [(n, v) for n, v in out]


def _table(kind: bytes, rows: list[tuple], width: str, version: int = 0) -> bytes:
    return full(kind, struct.pack(">I", len(rows)), *(struct.pack(">" + width, *r) for r in rows), version=version)


def data_atom(kind: bytes, data_type: int, value: bytes) -> bytes:
    return box(kind, full(b"data", b"\0\0\0\0", value, flags=data_type))


def freeform(mean: str, name: str, value: str) -> bytes:
    return box(b"----", full(b"mean", mean.encode()), full(b"name", name.encode()), full(b"data", b"\0\0\0\0", value.encode(), flags=1))


def video_entry(fourcc: bytes, width: int, height: int, *kids: bytes, depth: int = 24) -> bytes:
    return box(fourcc, b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HH", width, height), b"\0" * 46, struct.pack(">Hh", depth, -1), *kids)


def audio_entry(fourcc: bytes, channels: int, bits: int, rate: int, *kids: bytes) -> bytes:
    return box(fourcc, b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", channels, bits, 0, 0, rate << 16), *kids)


def track_box(number: int, handler: bytes, entry: bytes | None, timescale: int, samples: list[tuple[int, int, int]], chunks: list[list[int]], media_time: int | None = None, name: str = "", language: int = 0) -> bytes:
    """A ``trak`` of samples (size, duration, key) in chunks (64-bit offset, samples); a sync table only if some sample is no key."""
    total = sum(d for _, d, _ in samples)
    entries, at = [], 1
    for n, per_chunk in runs([n for _, n in chunks]):
        entries.append((at, per_chunk, 1))
        at += n
    stbl = [
        full(b"stsd", struct.pack(">I", 1), entry or video_entry(b"raw ", 2, 2)),
        _table(b"stts", runs([d for _, d, _ in samples]), "II"),
        _table(b"stsc", entries, "III"),
        full(b"stsz", struct.pack(">II", 0, len(samples)), *(struct.pack(">I", n) for n, _, _ in samples)),
        _table(b"co64", [(o,) for o, _ in chunks], "Q"),
    ]
    if not all(k for _, _, k in samples):
        stbl.append(_table(b"stss", [(i + 1,) for i, (_, _, k) in enumerate(samples) if k], "I"))
    mdia = box(
        b"mdia",
        full(b"mdhd", struct.pack(">QQIQHH", 0, 0, timescale, total, language, 0), version=1),
        full(b"hdlr", b"\0" * 4, handler, b"\0" * 12, name.encode() + b"\0"),
        box(b"minf", box(b"stbl", *stbl)),
    )
    tkhd = full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0), b"\0" * 60, struct.pack(">II", 2 << 16, 2 << 16))
    edts = box(b"edts", full(b"elst", struct.pack(">IQqI", 1, total, media_time, 1 << 16), version=1)) if media_time is not None else b""
    return box(b"trak", tkhd, edts, mdia)


def movie(
    frames: list[bytes],
    durations: list[int],
    timescale: int = 1000,
    handler: bytes = b"vide",
    entry: bytes | None = None,
    ctts: list[int] | None = None,
    sync: list[int] | None = None,
    per_chunk: int = 2,
    media_time: int | None = None,
    language: int = 0,
    handler_name: str = "",
    ilst: bytes = b"",
    wide: bool = False,
) -> bytes:
    """``ftyp``, ``mdat`` with the frames, and ``moov``; chunks of ``per_chunk`` samples. Signed offsets make a version 1 table."""
    head = box(b"ftyp", b"isom\0\0\0\0isom")
    data = b"".join(frames)
    start = len(head) + (16 if wide else 8)
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data if wide else box(b"mdat", data)
    offsets, at = [], start
    for k in range(0, len(frames), per_chunk):
        offsets.append(at)
        at += sum(map(len, frames[k : k + per_chunk]))
    entries = []
    if frames:
        whole, rest = divmod(len(frames), per_chunk)
        entries = ([(1, per_chunk, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    stbl = [
        full(b"stsd", struct.pack(">I", 1), entry or video_entry(b"raw ", 2, 2)),
        _table(b"stts", runs(durations), "II"),
        _table(b"stsc", entries, "III"),
        full(b"stsz", struct.pack(">II", 0, len(frames)), *(struct.pack(">I", len(f)) for f in frames)),
        _table(b"stco", [(o,) for o in offsets], "I"),
    ]
    if ctts is not None:
        signed = min(ctts, default=0) < 0
        stbl.append(_table(b"ctts", runs(ctts), "Ii" if signed else "II", version=int(signed)))
    if sync is not None:
        stbl.append(_table(b"stss", [(s,) for s in sync], "I"))
    total = sum(durations)
    mdia = box(
        b"mdia",
        full(b"mdhd", struct.pack(">IIII", 0, 0, timescale, total), struct.pack(">HH", language, 0)),
        full(b"hdlr", b"\0" * 4, handler, b"\0" * 12, handler_name.encode() + b"\0"),
        box(b"minf", box(b"stbl", *stbl)),
    )
    tkhd = full(b"tkhd", struct.pack(">IIII", 0, 0, 1, 0), b"\0" * 60, struct.pack(">II", 2 << 16, 2 << 16))
    edts = box(b"edts", _table(b"elst", [(total, media_time, 1 << 16)], "IiI")) if media_time is not None else b""
    udta = box(b"udta", full(b"meta", box(b"ilst", ilst))) if ilst else b""
    mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, timescale, total), b"\0" * 80)
    return head + mdat + box(b"moov", mvhd, box(b"trak", tkhd, edts, mdia), udta)
