"""Reports of whole files: packets, streams and format, one under the other, in seven formats.

Every row of the three tables becomes its piece of text where it lies. What stands around
pieces (brackets, headings, element ends) comes from one narrow row per file, commas from
the last number of a section. The pieces of a report are sorted by file, section and
number, never collected: a report of any length goes through sorted partitions, as one
dataset of lines or, file by file, through the streaming writer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .reports import FORMATS
from .running_totals import running
from .stream_mux import raw_layout, write_containers

#: Sections in their order, and the ranks of a report's pieces: begin, packets (head, items, end), streams (head, items, end), format, end.
PACKETS, STREAMS, FORMAT = "packet", "stream", "format"
BEGIN, END = 0, 8
ITEMS = {PACKETS: 2, STREAMS: 5, FORMAT: 7}
#: Types whose values stand without quotes where a format tells numbers from text.
_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _fields(rows: DataFrame, names: Sequence[str]) -> Column:
    """The fields that aren't null as ``k, v, bare``."""
    types = dict(rows.dtypes)
    each = [F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v"), F.lit(types[n] in _NUMBERS).alias("bare"))) for n in names]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<k:string,v:string,bare:boolean>>")


def _tags(rows: DataFrame, prefix: str) -> Column:
    """``tags`` (key, value pairs) in the same form, keys with a prefix."""
    if "tags" not in rows.columns:
        return F.array().cast("array<struct<k:string,v:string,bare:boolean>>")
    return F.coalesce(F.transform("tags", lambda t: F.struct(F.concat(F.lit(prefix), t["key"]).alias("k"), t["value"].alias("v"), F.lit(False).alias("bare"))), F.array().cast("array<struct<k:string,v:string,bare:boolean>>"))


def _json_value(p: Column) -> Column:
    return F.when(p["bare"], p["v"]).otherwise(F.concat(F.lit('"'), T.escape_json(p["v"]), F.lit('"')))


def _json_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), T.escape_json(p["k"]), F.lit('": '), _json_value(p))), ", ")


def piece(rows: DataFrame, section: str, names: Sequence[str], fmt: str) -> Column:
    """The text of one row; ``_n`` is its number within the file, ``_last`` whether nothing follows in its section."""
    fields, none = _fields(rows, names), F.lit("")
    joined = lambda pairs, make, sep: F.array_join(F.transform(pairs, make), sep)
    path = F.lit("format") if section == FORMAT else F.concat(F.lit(f"{section}s.{section}."), F.col("_n").cast("string"))
    if fmt == "default":
        pairs = F.concat(fields, _tags(rows, "TAG:"))
        return F.concat(F.lit(f"[{section.upper()}]\n"), joined(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"], F.lit("\n")), ""), F.lit(f"[/{section.upper()}]\n"))
    if fmt == "compact":
        pairs = F.concat(fields, _tags(rows, "tag:"))
        return F.concat(F.lit(section + "|"), joined(pairs, lambda p: F.concat(T.escape_compact(p["k"]), F.lit("="), T.escape_compact(p["v"])), "|"), F.lit("\n"))
    if fmt == "csv":
        pairs = F.concat(fields, _tags(rows, "tag:"))
        return F.concat(F.lit(section + ","), joined(pairs, lambda p: T.escape_csv(p["v"]), ","), F.lit("\n"))
    if fmt == "flat":
        pairs = F.concat(fields, _tags(rows, "tags."))
        return joined(pairs, lambda p: F.concat(path, F.lit("."), p["k"], F.lit("="), _json_value(p), F.lit("\n")), "")
    if fmt == "ini":
        part = lambda name, pairs: F.concat(F.lit("["), name, F.lit("]\n"), joined(pairs, lambda p: F.concat(p["k"], F.lit("="), T.escape_ini(p["v"]), F.lit("\n")), ""))
        tags = _tags(rows, "")
        more = F.when(F.size(tags) > 0, F.concat(F.lit("\n"), part(F.concat(path, F.lit(".tags")), tags))).otherwise(none)
        return F.concat(part(path, fields), more, F.lit("" if section == FORMAT else "\n"))
    if fmt == "json":
        tags = _tags(rows, "")
        inner = F.concat_ws(", ", F.nullif(_json_pairs(fields), none), F.when(F.size(tags) > 0, F.concat(F.lit('"tags": {'), _json_pairs(tags), F.lit("}"))))
        if section == FORMAT:
            return F.concat(F.lit('  "format": {'), inner, F.lit("}\n"))
        return F.concat(F.lit("    {"), inner, F.lit("}"), F.when(F.col("_last"), "\n").otherwise(",\n"))
    indent = " " * (4 if section == FORMAT else 8)
    attribute = lambda p: F.concat(F.lit(" "), p["k"], F.lit('="'), T.escape_xml(p["v"]), F.lit('"'))
    tags = _tags(rows, "")
    tag = lambda p: F.concat(F.lit(f'{indent}        <tag key="'), T.escape_xml(p["k"]), F.lit('" value="'), T.escape_xml(p["v"]), F.lit('"/>\n'))
    body = F.concat(F.lit(f">\n{indent}    <tags>\n"), joined(tags, tag, ""), F.lit(f"{indent}    </tags>\n{indent}</{section}>\n"))
    return F.concat(F.lit(f"{indent}<{section}"), joined(fields, attribute, ""), F.when(F.size(tags) > 0, body).otherwise("/>\n"))


def _frames(fmt: str, root: str) -> list[tuple[int, str]]:
    """What stands around the pieces: (rank, text)."""
    if fmt == "json":
        return [(BEGIN, '{\n'), (1, '  "packets": [\n'), (3, "  ],\n"), (4, '  "streams": [\n'), (6, "  ],\n"), (END, "}\n")]
    if fmt == "xml":
        return [(BEGIN, f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n'), (1, "    <packets>\n"), (3, "    </packets>\n"), (4, "    <streams>\n"), (6, "    </streams>\n"), (END, f"</{root}>\n")]
    return [(BEGIN, f"# {root} output\n\n")] if fmt == "ini" else []


def nested_report(formats: DataFrame, streams: DataFrame, packets: DataFrame, fields: dict[str, Sequence[str]], fmt: str, root: str = "report") -> DataFrame:
    """``nested_reports`` in one format, without its name."""
    return nested_reports(formats, streams, packets, fields, [fmt], root).drop("format")


def nested_reports(formats: DataFrame, streams: DataFrame, packets: DataFrame, fields: dict[str, Sequence[str]], fmts: Sequence[str], root: str = "report") -> DataFrame:
    """``format, file_id, rank, number, piece``: a report in each format of every file of ``formats``, piece by piece in the order of ``rank, number``.

    Rows are numbered once, whatever the formats; each becomes its pieces where it lies.

    ``streams`` have ``stream_index``, ``packets`` have ``packet_index``, all have the
    ``fields`` of their section and may have ``tags``. Fields that are null are left out;
    whole numbers stand bare in JSON and flat reports. A file without packets or streams
    has empty sections; rows of files that ``formats`` doesn't have are left out.
    """
    for fmt in fmts:
        if fmt not in FORMATS:
            raise ValueError(f"unknown report format {fmt!r}")

    def pieces(rows: DataFrame, section: str, number: Column) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), piece(rows, section, fields[section], f).alias("piece")) for f in fmts])).alias("f")
        return rows.select("file_id", number.alias("number"), each).select("f.format", "file_id", F.lit(ITEMS[section]).alias("rank"), "number", "f.piece")

    files = formats.select("file_id").distinct()
    out = []
    for section, rows, order in ((PACKETS, packets, "packet_index"), (STREAMS, streams, "stream_index")):
        rows = running(rows.join(files, "file_id", "left_semi"), ["file_id"], order, {"_n": F.lit(1).cast("bigint")}).withColumn("_n", F.coalesce("_n", F.lit(0).cast("bigint")))
        if "json" in fmts:
            counts = rows.groupBy("file_id").agg(F.max("_n").alias("_most"))
            rows = rows.join(counts, "file_id").withColumn("_last", F.col("_n") == F.col("_most")).drop("_most")
        out.append(pieces(rows, section, F.col("_n")))
        if "json" in fmts:  # an empty list has an empty line
            out.append(files.join(counts, "file_id", "left_anti").select(F.lit("json").alias("format"), "file_id", F.lit(ITEMS[section]).alias("rank"), F.lit(0).cast("bigint").alias("number"), F.lit("    \n").alias("piece")))
    zero = F.lit(0).cast("bigint").alias("number")
    out.append(pieces(formats, FORMAT, F.lit(0).cast("bigint")))
    if frames := [(fmt, r, t) for fmt in fmts for r, t in _frames(fmt, root)]:
        around = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.lit(r).alias("rank"), F.lit(t).alias("piece")) for f, r, t in frames])).alias("f")
        out.append(files.select("file_id", around).select("f.format", "file_id", "f.rank", zero, "f.piece"))
    both = out[0]
    for rows in out[1:]:
        both = both.unionByName(rows)
    return both


def write_lines(report: DataFrame, folder: str) -> None:
    """All reports as one dataset of text, in the order of files: range partitions over file, section and number."""
    ordered = report.where("piece != ''").orderBy("file_id", "rank", "number")
    ordered.select(F.expr("substring(piece, 1, length(piece) - 1)").alias("line")).write.text(folder)


def write_files(report: DataFrame, folder: str, extension: str | None = None) -> DataFrame:
    """A file for each report, written as a stream; run by the reader of the rows ``file_id, path, packets, bytes``. Without an extension the formats are folders and extensions."""
    place = (F.col("rank").cast("bigint") * F.lit(1 << 56) + F.col("number")).alias("packet_index")
    kinds = [F.col("format").alias("kind")] if extension is None else []
    pieces = report.select(*kinds, "file_id", F.lit(0).alias("stream_index"), place, F.col("piece").cast("binary").alias("payload"))
    return write_containers(pieces, folder, extension, raw_layout())[0]
