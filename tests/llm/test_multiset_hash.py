from collections import Counter
from hashlib import sha256

import duckdb
from pyspark.sql import functions as F

from cuemill.llm import multiset_hash as mh
from cuemill.llm.sql import multiset_sql

from .conftest import TEXTS

M = 1 << mh.BITS


def lanes(pieces, ones):
    """Lanes of a multiset of pieces by plain whole numbers."""
    out = []
    hashes = [sha256(p.encode()).hexdigest() for p in pieces]
    words = [[int(h[15 * k : 15 * k + 15], 16) for k in range(4)] for h in hashes]
    for k in range(4):
        for j in range(mh.BITS) if ones else [0]:
            out.append([sum((w[k] >> (j + 20 * b)) & (1 if ones else M - 1) for w in words) % M for b in range(3)])
    return out


def brute(text):
    text = text or ""
    sentences = [s for s in __import__("re").split(mh.SENTENCE_END, text) if s]
    words = lanes(text.split("\n"), False) + lanes(sentences, True) + [[len(sentences) % M, 0, 0]]
    return "".join(f"{a + (b << 21) + (c << 42):016x}" for a, b, c in words)


def dice(a, b):
    x, y = (Counter(s for s in __import__("re").split(mh.SENTENCE_END, t) if s) for t in (a, b))
    both = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 2 * sum(v * y[k] for k, v in x.items()) / both if both else float(a == b)


def expected(rows):
    """rows (doc_id, text) in the order of the operator."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, sha256((r[1] or "").encode()).hexdigest()))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        e = t[: n - n // 2] + after[: n // 2]
        yield i, n, sha256(e.encode()).hexdigest(), brute(t), brute(e), dice(t, e), dice(t, after)


def test_every_document_against_brute_force_and_sql(documents, rows, sf_dir):
    got = mh.fingerprints(documents).toPandas().set_index("doc_id").sort_index()
    off = []
    for i, n, digest, fp, efp, near_edited, near_next in expected(list(zip(rows.doc_id, rows.text))):
        g = got.loc[i]
        assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (n, digest, fp, efp)
        off += [g.near_edited - near_edited, g.near_next - near_next]
    assert sum(x * x for x in off) / len(off) < 0.08**2 and max(map(abs, off)) < 0.35
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    sql = con.sql(multiset_sql()).df().set_index("doc_id").sort_index()
    for c in sql.columns:
        assert sql[c].tolist() == got[c].tolist(), c


def test_paragraphs_in_any_order_in_and_out(spark):
    df = spark.createDataFrame([("a. b\nc\nd\nc", "c\nd\nc\na. b", "a. b\nc", "d\nc", "a. b\nc\nd")], "x string, y string, p string, q string, w string")
    fp = {c: mh.fingerprint(F.col(c)) for c in df.columns}
    r = df.select(
        (fp["x"] == fp["y"]).alias("order"), (mh.plus(fp["p"], fp["q"]) == fp["x"]).alias("plus"), (mh.minus(fp["x"], fp["q"]) == fp["p"]).alias("minus"),
        (fp["x"] == fp["w"]).alias("fewer"), (mh.minus(fp["x"], fp["w"]) == mh.fingerprint(F.lit("c"))).alias("one"),
    ).first()
    assert (r.order, r.plus, r.minus, r.fewer, r.one) == (True, True, True, False, True)


def test_lanes_wrap_on_their_own(spark):
    """Adding a fingerprint to itself 2^20 times gives zero in every lane."""
    df = spark.createDataFrame([("one. two. three\nfour",)], "t string").select(mh.fingerprint(F.col("t")).alias("f"))
    for _ in range(mh.BITS):
        df = df.select(mh.plus(F.col("f"), F.col("f")).alias("f"))
        df = df.sparkSession.createDataFrame(df.collect(), "f array<bigint>")
    assert set(df.first().f) == {0}


def test_awkward(awkward, empty):
    got = sorted(mh.fingerprints(awkward).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    texts = list(enumerate(TEXTS)) + [(None, "no id")]  # repeated rows are one document that comes twice
    want = {i: (n, s, a, b) for i, n, s, a, b, _, _ in expected(texts)}
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert mh.fingerprints(empty).count() == 0


def test_one_id_many_texts_and_one_row(spark):
    rows = [(7, f"text {k}. more {k}") for k in range(30)]
    got = {r.fingerprint: r for r in mh.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, n, s, a, b, *_ in expected(rows):
        assert (got[a].edited_sha256, got[a].edited_fingerprint) == (s, b)
    alone = mh.fingerprints(spark.createDataFrame([(1, "ab. cd")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha256(b"ab.ab.").hexdigest()


def test_megabytes(spark):
    text = "Some words of a sentence. " * 20_000 + "\n".join(f"line {k}" for k in range(20_000))
    got = {r.doc_id: r for r in mh.fingerprints(spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")).collect()}
    assert got[1].fingerprint == brute(text) and got[1].n_chars == len(text)
