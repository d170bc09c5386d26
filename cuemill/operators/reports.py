"""Reports as text: one line or block per row in each output format, and tables as Parquet.

Rendering is a column expression, so a report of any size is written by the tasks that
hold its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FORMATS = ("default", "compact", "csv", "flat", "ini", "json", "xml")


def _known(fields: Sequence[str], make) -> Column:
    """Rendered fields that aren't null, as an array."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), make(f, F.col(f).cast("string"))) for f in fields]))


def render(rows: DataFrame, section: str, fields: Sequence[str], fmt: str, keys: Sequence[str] = ("file_id",), order: Sequence[str] = ()) -> DataFrame:
    """``keys, line``: each row as text. Flat and ini name rows by their number within the first key."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown report format {fmt!r}")
    name = F.lit(section)
    if fmt in ("flat", "ini") and section != "format":
        w = Window.partitionBy(keys[0]).orderBy(*(order or keys))
        rows = rows.withColumn("_n", F.row_number().over(w) - 1)
        name = F.concat(F.lit(f"{section}s.{section}."), F.col("_n").cast("string"))
    lit, tag = F.lit, section.upper()
    if fmt == "default":
        line = F.concat(lit(f"[{tag}]\n"), F.array_join(_known(fields, lambda f, v: F.concat(lit(f"{f}="), v, lit("\n"))), ""), lit(f"[/{tag}]"))
    elif fmt == "compact":
        line = F.array_join(F.concat(F.array(lit(section)), _known(fields, lambda f, v: F.concat(lit(f"{f}="), T.escape_compact(v)))), "|")
    elif fmt == "csv":
        line = F.array_join(F.concat(F.array(lit(section)), F.array(*[T.escape_csv(F.coalesce(F.col(f).cast("string"), lit("N/A"))) for f in fields])), ",")
    elif fmt == "flat":
        quoted = lambda f, v: F.concat(name, lit(f".{f}="), lit('"'), F.replace(F.replace(v, lit("\\"), lit("\\\\")), lit('"'), lit('\\"')), lit('"'))
        line = F.array_join(_known(fields, quoted), "\n")
    elif fmt == "ini":
        line = F.concat(lit("["), name, lit("]\n"), F.array_join(_known(fields, lambda f, v: F.concat(lit(f"{f}="), T.escape_ini(v))), "\n"), lit("\n"))
    elif fmt == "json":
        line = F.concat(lit("{"), F.array_join(_known(fields, lambda f, v: F.concat(lit(f'"{f}": "'), T.escape_json(v), lit('"'))), ", "), lit("}"))
    else:
        line = F.concat(lit(f"<{section} "), F.array_join(_known(fields, lambda f, v: F.concat(lit(f'{f}="'), T.escape_xml(v), lit('"'))), " "), lit("/>"))
    return rows.select(*keys, line.alias("line"))


def write_report(rows: DataFrame, path: str, section: str, fields: Sequence[str], fmt: str, keys: Sequence[str] = ("file_id",)) -> None:
    """Text files ordered by the keys, through range partitions."""
    render(rows, section, fields, fmt, keys).orderBy(*keys).select("line").write.text(path)


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: str | None = None) -> None:
    """Parquet tables side by side below ``path``, partitioned where they have the column."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and partition_by in df.columns:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{path}/{name}")
