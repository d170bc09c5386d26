"""Ordered tag lists: ARRAY<STRUCT<key, value>> with repeats, matched by case-insensitive key unless told otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, _UPPER, _LOWER)


def _same(a: Column, b: Column, exact: bool) -> Column:
    return a == b if exact else ascii_lower(a) == ascii_lower(b)


def tags_all(tags: Column, key: Column | str, exact: bool = False) -> Column:
    key = key if isinstance(key, Column) else F.lit(key)
    return F.filter(tags, lambda t: _same(t["key"], key, exact))


def tags_get(tags: Column, key: Column | str, exact: bool = False) -> Column:
    """The first matching value, or null."""
    return F.get(tags_all(tags, key, exact), F.lit(0))["value"]


def tags_prefix(tags: Column, prefix: str, exact: bool = False) -> Column:
    return F.filter(tags, lambda t: (t["key"] if exact else ascii_lower(t["key"])).startswith(prefix if exact else prefix.lower()))


def tags_remove(tags: Column, key: str, exact: bool = False) -> Column:
    """Without the first match."""
    at = F.array_position(F.transform(tags, lambda t: _same(t["key"], F.lit(key), exact)), True)
    return F.filter(tags, lambda t, i: i != at - 1)


def tags_set(tags: Column, key: Column | str, value: Column | str, mode: str = "overwrite", exact: bool = False) -> Column:
    """Set a tag: ``overwrite`` (key text too), ``keep``, ``append`` to the value, ``multiple`` or ``dedup``.

    A null or empty key, or a NUL in either, gives null.
    """
    key = key if isinstance(key, Column) else F.lit(key)
    value = value if isinstance(value, Column) else F.lit(value)
    new = F.struct(key.alias("key"), value.alias("value"))
    added = F.concat(tags, F.array(new))
    at = F.array_position(F.transform(tags, lambda t: _same(t["key"], key, exact)), True)
    if mode == "multiple":
        out = added
    elif mode == "dedup":
        out = F.when(F.exists(tags, lambda t: _same(t["key"], key, exact) & (t["value"] == value)), tags).otherwise(added)
    else:
        change = {
            "overwrite": lambda t: new,
            "keep": lambda t: t,
            "append": lambda t: F.struct(key.alias("key"), F.concat(t["value"], value).alias("value")),
        }[mode]
        out = F.when(at == 0, added).otherwise(F.transform(tags, lambda t, i: F.when(i == at - 1, change(t)).otherwise(t)))
    ok = (F.length(key) > 0) & (F.instr(key, "\0") == 0) & (F.instr(value, "\0") == 0)
    return F.when(ok, out)


def format_pairs(tags: Column, between: str = "=", after: str = ":") -> Column:
    """``key=value:key=value`` with backslashes before separators and backslashes."""
    if between == after or "\\" in (between, after):
        raise ValueError("separators must differ and not be a backslash")
    pattern = "([" + "".join("\\" + c for c in ("\\", between, after)) + "])"
    escape = lambda c: F.regexp_replace(c, pattern, r"\\$1")
    return F.array_join(F.transform(tags, lambda t: F.concat(escape(t["key"]), F.lit(between), escape(t["value"]))), after)


def split_pairs(text: str, between: str, after: str) -> tuple[list[tuple[str, str]], str | None]:
    """Pairs up to the first error, and the error."""
    found: list[tuple[str, str]] = []
    at, n = 0, len(text)

    def token(stops: str) -> tuple[str, str | None]:
        nonlocal at
        out = []
        while at < n:
            c = text[at]
            at += 1
            if c in stops:
                return "".join(out), c
            if c == "\\":
                if at >= n:
                    raise ValueError("token ends with an escape")
                c = text[at]
                at += 1
            out.append(c)
        return "".join(out), None

    try:
        while at < n:
            key, stop = token(between)
            if stop is None or not key:
                raise ValueError("missing key or separator")
            found.append((key, token(after)[0]))
    except ValueError as e:
        return found, str(e)
    return found, None


def parse_pairs(text: Column, between: str = "=", after: str = ":", keep_repeats: bool = False) -> Column:
    """``struct(tags, error)``; pairs before an error are kept. Later values of a key replace earlier ones unless repeats are kept."""
    kind = T.StructType([T.StructField("tags", TAGS), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def parse(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            pairs, error = split_pairs(v or "", between, after)
            if not keep_repeats:
                merged: dict[str, tuple[str, str]] = {}
                for k, x in pairs:
                    merged[k.translate(str.maketrans(_UPPER, _LOWER))] = (k, x)
                pairs = list(merged.values())
            rows.append(([{"key": k, "value": x} for k, x in pairs], error))
        return pd.DataFrame(rows, columns=["tags", "error"])

    return parse(text)


def merge_tags(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Tag rows (``key, value``, in ``order``) as one list per group of ``keys``.

    A later value replaces an earlier one of the same key and its spelling, in the earlier
    one's place.
    """
    each = rows.groupBy(*keys, ascii_lower(F.col("key")).alias("_k")).agg(F.max_by(F.struct("key", "value"), order).alias("_tag"), F.min(order).alias("_first"))
    lists = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", "_tag"))).alias("_tags"))
    return lists.select(*keys, F.transform("_tags", lambda t: t["_tag"]).alias("tags"))


def language_code(code: Column) -> Column:
    """Three letters of five bits each; null for 0 and for what is no letter."""
    letters = [F.shiftright(code.cast("int"), s).bitwiseAND(F.lit(31)) for s in (10, 5, 0)]
    ok = (code != 0)
    for x in letters:
        ok = ok & x.between(1, 26)
    return F.when(ok, F.concat(*[F.char(x + 96) for x in letters]))


def explode_tags(df: DataFrame, tags: str, *keys: str) -> DataFrame:
    """One row per tag with its place ``ord``."""
    return df.select(*keys, F.posexplode(tags).alias("ord", "tag")).select(*keys, "ord", "tag.key", "tag.value")


