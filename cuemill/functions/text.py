"""Text of reports: escapes of each output format, and byte dumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_compact(text: Column) -> Column:
    return _replaced(text, [("\\", "\\\\"), ("|", "\\|"), ("=", "\\="), ("\n", "\\n"), ("\r", "\\r")])


def escape_ini(text: Column) -> Column:
    return _replaced(text, [("\\", "\\\\"), (":", "\\:"), ("\n", "\\n"), ("\r", "\\r")])


def escape_xml(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ("\r", "&#13;")])


def escape_csv(text: Column) -> Column:
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), _replaced(text, [('"', '""')]), F.lit('"'))).otherwise(text)


def escape_json(text: Column) -> Column:
    """Only the text within the quotes; control characters become ``\\u00xx``."""
    out = _replaced(text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])
    for n in [*range(0x20), *range(0x7F, 0xA0)]:
        if chr(n) not in "\n\r\t":
            out = F.replace(out, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    return out


def hex_dump(payload: Column) -> Column:
    """16 bytes a line: offset, eight groups of two bytes, printable ASCII; a line end before and after each line."""
    n = F.ceil(F.octet_length(payload) / 16).cast("int")
    text = F.hex(payload)

    def line(i: Column) -> Column:
        part = F.lower(F.substring(text, i * 32 + 1, F.lit(32)))
        groups = [F.rpad(F.substring(part, k, 4), 4, " ") for k in range(1, 33, 4)]
        raw = F.decode(F.substring(payload, i * 16 + 1, F.lit(16)), "ISO-8859-1")
        return F.concat(F.lpad(F.lower(F.hex(i * 16)), 8, "0"), F.lit(": "), F.concat_ws(" ", *groups), F.lit("  "), F.regexp_replace(raw, "[^ -~]", "."), F.lit("\n"))

    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), line)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("\n"), F.array_join(lines, ""))
