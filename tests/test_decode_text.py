"""Texts decoded in pieces of a batch, once whatever uses them."""

from cuemill.jobs import catalog
from cuemill.operators import decode
from pyspark.sql import functions as F


def test_pieces_of_a_batch_keep_their_order(spark):
    """Texts beyond a piece's bytes, errors and nulls among them."""
    n = decode.DECODED_BYTES // 2
    raw = [(0, b"\xff\xfe" + ("ä" * n).encode("utf-16-le"), True), (1, b"\xff", False), (2, None, True), (3, b"odd", True), (4, ("x" * n).encode("utf-16-be"), True), (5, b"\xc3\xa9", False), (6, b"", False)]
    rows = spark.createDataFrame(raw, "i int, data binary, wide boolean").coalesce(1)
    got = {r.i: (r.chars, r.head, r.error) for r in rows.select("i", decode.decode_text(F.col("data"), F.col("wide")).alias("t")).select("i", F.length("t.text").alias("chars"), F.substring("t.text", 1, 1).alias("head"), F.col("t.error").alias("error")).collect()}
    assert got == {0: (n, "ä", None), 1: (None, None, "text is not valid"), 2: (0, "", None), 3: (None, None, "UTF-16 text of odd length"), 4: (n, "x", None), 5: (1, "é", None), 6: (0, "", None)}


def test_texts_are_decoded_once(spark, sf_dir):
    """A filter by the error and what uses the text share one pass through Python."""
    plan = catalog.QUERIES["decoded_texts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
