import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from cuemill.llm import line_dedup
from cuemill.llm.queries import QUERIES
from cuemill.llm.sql import ORACLES


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    columns = ["page_id", "host", "n_lines", "n_dropped", "text_md5"]
    got = QUERIES["op5_line_dedup"](spark, sf_dir).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(ORACLES["op5_line_dedup"]).select(", ".join(columns)).fetchall()))


def test_against_brute_force(spark):
    rng = random.Random(2)
    pages = []
    for i in range(120):
        host = rng.choice(["http://a.example/x", "https://B.example:80/", "http://c.example", None])
        lines = [f"unique {i} {k}" for k in range(3)] + [x for x in ("menu", "footer", "rare") if rng.random() < {"menu": 0.9, "footer": 0.35, "rare": 0.1}[x]]
        rng.shuffle(lines)
        pages.append((i, host, "<p>" + "</p>\n<p>".join(lines) + "</p><script>menu</script>"))
    pages.append((500, "http://alone.example/", "<p>menu</p>"))
    got = line_dedup.drop_boilerplate(spark.createDataFrame(pages, "page_id bigint, url string, html string")).toPandas().set_index("page_id")
    parsed = {i: (u.split("/")[2].lower() if u else None, [x for x in h.split("<script")[0].replace("<p>", "\n").replace("</p>", "\n").split("\n") if x]) for i, u, h in pages}
    for i, (host, lines) in parsed.items():
        same = [x for h, x in parsed.values() if h == host]
        drop = {x for x in lines if host and len(same) >= 5 and sum(x in p for p in same) > 0.3 * len(same)}
        kept = [x for x in lines if x not in drop]
        assert got.text[i] == "\n".join(kept) and got.n_lines[i] == len(lines) and got.n_dropped[i] == len(lines) - len(kept)


def test_awkward(spark):
    rows = [(1, None, None, "x"), (None, "no address", "<p>a</p>", None), (2, "http://h/", "", None)] + [(3, "http://h/", "<p>same</p>", None)] * 6 + [(4, "http://h/", "word " * 50_000, None)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")).toPandas()
    assert len(got) == len(rows) and set(got[got.page_id == 3].n_dropped) == {1} and set(got[got.page_id == 4].n_dropped) == {0}
    assert got[got.page_id.isna()].host.isna().all()
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert hashlib.md5(got[got.page_id == 2].text.iloc[0].encode()).hexdigest() == hashlib.md5(b"").hexdigest()


OLD_TRIM = r"^[ \t\r\f]+|[ \t\r\f]+$"


def plain_lines(html):
    """Lines by the patterns alone."""
    text = re.sub(line_dedup.HIDDEN, "", html)
    text = re.sub(line_dedup.TAG, "", re.sub(line_dedup.BREAKS, "\n", text, flags=re.ASCII))
    return [x for x in (re.sub(OLD_TRIM, "", y) for y in text.split("\n")) if x]


def test_lines_are_those_of_the_patterns(spark):
    """Random pages of broken markup, masked characters included."""
    rng = random.Random(5)
    parts = ["<script>", "<SCRIPT a", "</script>", "</Script>", "<style>", "</style>", "<style", "<!--", "-->", "<!-->", "<p>", "<p ", "</p>", "<b", ">", "<", "x", " y ", "\n", "\x01", "\x010", "\x011", "é", "/>", "<br/>"]
    pages = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(3000)]
    got = {r.i: r.lines for r in spark.createDataFrame(pages, "i int, html string").select("i", line_dedup.lines_of(F.col("html")).alias("lines")).collect()}
    for i, html in pages:
        assert got[i] == plain_lines(html), html


@pytest.mark.parametrize("part", ["<", "<!--", "<script>", "<script ", "<style>", "<p ", "<a", "<!-->", "-->", " ", "</script>", "<p>", "<script></style>"])
@pytest.mark.parametrize("end", ["", "x</script>", "-->", ">x"])
def test_a_megabyte_of_broken_markup_takes_seconds(spark, part, end):
    html = part * ((1 << 20) // len(part)) + end
    began = time.time()
    spark.createDataFrame([(1, html)], "i int, html string").select(F.size(line_dedup.lines_of(F.col("html")))).collect()
    assert time.time() - began < 10
