"""WARC records in ZIP packages, written by Spark tasks and read back in ranges.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz``
holds one gzip member per record, ``indexes/index.cdxj`` one line per record with its
offset and length. A reader fetches the end of the file, the central directory (with its
ZIP64 parts) and the index; each record is then one range read. Nothing is extracted.

Packages lie in the shared folder and are opened through ``pyarrow.fs``, so any store that
it knows by URI will do. A writing task makes files of names of its own and reports them;
only what successful tasks report counts, so a task may run again at any time.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, new_folder

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
#: A package is closed when it holds so many bytes or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 100_000
#: Records whose offsets lie in one such stretch are read by one task, which reads about so many bytes.
STRETCH_BYTES, TASK_BYTES = 1 << 20, 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP directories


def central_directory(file: BinaryIO, size: int) -> dict[str, dict]:
    """Members by name, from the end of the file, its ZIP64 records included."""

    def at(offset: int, n: int) -> bytes:
        if offset < 0 or offset + n > size:
            raise ValueError("truncated ZIP file")
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    k = tail.rfind(b"PK\5\6")
    while k >= 0 and (len(tail) < k + 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] > len(tail)):
        k = tail.rfind(b"PK\5\6", 0, k)
    if k < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, k + 10)
    end = tail_at + k
    if end >= 20 and (locator := at(end - 20, 20))[:4] == b"PK\6\7":
        record_at = struct.unpack_from("<Q", locator, 8)[0]
        record = at(record_at, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, members, p = at(start, length), {}, 0
    for _ in range(entries):
        if raw[p : p + 4] != b"PK\1\2":
            raise ValueError("bad central directory entry")
        flags, method, _, _, crc, packed, full, n, m, c, disk, _, _, local = struct.unpack_from("<HHHHIIIHHHHHII", raw, p + 8)
        name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = raw[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # the long forms of those fields that are all ones, in this order
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[q + 4 : q + 4 + k // 8 * 8])]
                if full == 0xFFFFFFFF:
                    full = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if local == 0xFFFFFFFF:
                    local = wide.pop(0)
            q += 4 + k
        members[name] = {"method": method, "packed": packed, "size": full, "local": local, "crc": crc}
        p += 46 + n + m + c
    return members


def stored_at(file: BinaryIO, member: dict) -> int:
    """Where a stored member's bytes begin."""
    if member["method"] != 0:
        raise ValueError("only stored members can be read in ranges")
    file.seek(member["local"])
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header")
    n, m = struct.unpack_from("<HH", head, 26)
    return member["local"] + 30 + n + m


# --- records


def record_id(page_id: object) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; header values are kept free of control characters."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and what follows the blank line."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}, rest


def parse(raw: bytes) -> dict:
    """A record's identifiers and its payload: hashed where it is here, as its headers say for a revisit."""
    head, rest = fields(raw)
    http, payload = fields(rest[: int(head["content-length"])])
    kind = head["warc-type"]
    if kind == "revisit":
        n, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
    else:
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
    refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
    return {"page_id": page_of(head["warc-record-id"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": refers}


# --- jobs


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages with digest, record type and the page that a revisit refers to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.octet_length(html).alias("n"), F.sha2(html.cast("binary"), 256).alias("digest"))
    first = pages.select(F.col(id_col).cast("long").alias("page_id"), html.alias("html")).where(F.octet_length("html") >= LEAST_REVISIT).groupBy(F.sha2(F.col("html").cast("binary"), 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # written first, so that its size is known: a short list is broadcast and the pages stay where they are
    joined = rows.join(materialise(first.where("copies > 1").select("digest", "first"), "warc-repeated"), "digest", "left")
    again = F.coalesce(F.col("n") >= LEAST_REVISIT, F.lit(False)) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


class Package:
    """A ZIP package that is being written."""

    def __init__(self, folder: str):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        self.name = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.sink = store.open_output_stream(f"{path}/{self.name.rpartition('/')[2]}")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, url: str | None, kind: str, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.data.write(packed)
        self.index.append(f"{quote(url or '', safe='')} 20200101000000 " + json.dumps({"page": page_id, "type": kind, "offset": self.size, "length": len(packed), "filename": DATA}))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "\n".join(self.index))
        self.zip.close()
        self.sink.close()
        return self.name, len(self.index), self.size


def write_packages(rows: DataFrame, folder: str, most_bytes: int = PACKAGE_BYTES, most_records: int = PACKAGE_RECORDS) -> DataFrame:
    """Write planned pages; ``package, records, bytes`` of what was written, as a table."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: Package | None = None
        for frame in frames:
            done = []
            for page_id, url, html, digest, kind, refers_to in frame.itertuples(index=False, name=None):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                open_ = open_ or Package(folder)
                open_.add(page_id, url, kind, record(page_id, url, html.encode("utf-8"), digest, kind, refers_to))
                if open_.size >= most_bytes or len(open_.index) >= most_records:
                    done.append(open_.close())
                    open_ = None
            if done:
                yield pd.DataFrame(done, columns=["package", "records", "bytes"])
        if open_ is not None:
            yield pd.DataFrame([open_.close()], columns=["package", "records", "bytes"])

    return materialise(rows.mapInPandas(write, "package string, records bigint, bytes bigint"), "packages")


def read_index(packages: DataFrame) -> DataFrame:
    """``package, start, length``: where each record lies in its package, from directory and index alone."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for package in frame["package"]:
                store, path = fs.FileSystem.from_uri(package)
                with store.open_input_file(path) as file:
                    members = central_directory(file, file.size())
                    base, at = stored_at(file, members[DATA]), stored_at(file, members[INDEX])
                    file.seek(at)
                    lines = file.read(members[INDEX]["size"]).decode("utf-8").splitlines()
                entries = [json.loads(x.split(" ", 2)[2]) for x in lines if x]
                yield pd.DataFrame({"package": package, "start": [base + e["offset"] for e in entries], "length": [e["length"] for e in entries]})

    return packages.select("package").repartition(min(10_000, max(1, packages.count())), "package").mapInPandas(read, "package string, start bigint, length bigint")


def read_records(index: DataFrame, tasks: int = 8) -> DataFrame:
    """Range-read and parse every record of an index, dealt over so many tasks by stretches of the packages."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for package, part in frame.groupby("package", sort=False):
                store, path = fs.FileSystem.from_uri(package)
                with store.open_input_file(path) as file:
                    for start, length in zip(part["start"], part["length"]):
                        file.seek(start)
                        found.append(parse(gzip.decompress(file.read(length))))
            out = pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = index.withColumn("stretch", F.floor(F.col("start") / STRETCH_BYTES)).repartition(tasks, "package", "stretch").sortWithinPartitions("package", "start")
    return dealt.select("package", "start", "length").mapInPandas(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every page, then read all packages back: one row per record.

    Null html has an empty payload. Of equal payloads of at least 100 bytes, rows with the
    smallest page_id are responses and others revisit it; a null page_id counts as larger
    than any. Shorter payloads are responses. Repeated rows are written each. Null urls
    have no target; an empty table gives no packages and no rows. Ids are whole numbers;
    other columns are ignored, whatever their names.
    """
    packages = write_packages(planned(pages, id_col, url_col, html_col), new_folder(pages.sparkSession, "warc"))
    return read_records(read_index(packages), tasks_for(packages))


def tasks_for(packages: DataFrame) -> int:
    """Reading tasks in proportion to what the packages hold."""
    return max(1, -(-(packages.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
