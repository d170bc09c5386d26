"""Line deduplication by site-relative frequency.

A line is boilerplate on a host when more than a set part of the host's pages hold it.
Pages of a line and pages of a host are counted with map-side combining, so a host that
holds a third of all pages costs no task more than its share. The lines to drop are one
short list per host: a line on more than the part r of the pages counts once on each, so
there are fewer of them than the mean number of distinct lines on a page divided by r.
Only these lists are joined back to the pages.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: Elements without text, elements that end a line, and any tag.
HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
#: Per kind of hidden element its opening, and what lies before the last place where it may close.
CLOSED = {r"(?i)<(?=script)": r"(?is)^.*>(?=[^>]*</script>)", r"(?i)<(?=style)": r"(?is)^.*>(?=[^>]*</style>)", r"<(?=!--)": r"(?s)^.*(?=-->)"}
#: Followed by 1 it stands for a masked ``<``, by 0 for itself.
MASK = "\x01"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _before_last(text: Column, pattern: str, new: str) -> Column:
    """Replace tags up to the last ``>``. Beyond it no tag ends, and to look there for the end of every ``<`` would take the square of its length."""
    cut = lambda t, rest: F.concat(F.regexp_replace(F.left(t, F.length(t) - F.length(rest)), pattern, new), rest)
    return _let(text, lambda t: _let(F.substring_index(t, ">", -1), lambda rest: cut(t, rest)))


def _masked(text: Column, opening: str, closed: str) -> Column:
    mask = lambda t: lambda n: F.concat(F.left(t, n), F.regexp_replace(F.substr(t, n + 1), opening, MASK + "1"))
    return _let(text, lambda t: F.when(t.rlike(opening), _let(F.length(F.regexp_extract(t, closed, 0)), mask(t))).otherwise(t))


def _without_hidden(text: Column) -> Column:
    """Drops what HIDDEN matches. Openings after which nothing closes are masked meanwhile, so that none is searched to the end of the page."""
    text = F.replace(text, F.lit(MASK), F.lit(MASK + "0"))
    for opening, closed in CLOSED.items():
        text = _masked(text, opening, closed)
    text = F.regexp_replace(text, HIDDEN, "")
    return F.replace(F.replace(text, F.lit(MASK + "1"), F.lit("<")), F.lit(MASK + "0"), F.lit(MASK))


def lines_of(html: Column) -> Column:
    """The visible lines of a page, trimmed, without empty ones; the time is in proportion to the page, whatever it holds."""
    text = _without_hidden(F.coalesce(html, F.lit("")))
    text = _before_last(_before_last(text, BREAKS, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t\r\f"))), lambda s: s != "")


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(pages: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """``host, dropped`` from ``host, lines``: per host the digests of its boilerplate lines."""
    known = pages.where("host is not null")
    totals = known.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    each = known.select("host", F.explode(F.array_distinct(F.transform("lines", digest))).alias("line"))
    on = each.groupBy("host", "line").agg(F.count("*").alias("n"))
    often = on.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("dropped"))


def drop_boilerplate(pages: DataFrame, ratio: float = 0.3, least_pages: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` for every page; text is what stays, joined by line ends.

    A line repeated on one page counts once for it, and all its copies go. Hosts with fewer
    than ``least_pages`` pages keep everything, as do pages without a host. Null html has
    no lines. Repeated rows count as pages of their own; an empty table gives no rows; other
    columns are not looked at.
    """
    lined = materialise(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines")), "lines")
    dropped = materialise(boilerplate(lined, ratio, least_pages), "boilerplate")
    joined = lined.join(dropped, "host", "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda s: ~F.array_contains(F.col("dropped"), digest(s))))
    return joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
