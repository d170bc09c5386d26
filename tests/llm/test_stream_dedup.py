import hashlib

from pyspark.sql import functions as F

from cuemill.llm import stream_dedup


def brute(pairs):
    """id -> (keep_id, group_size, kept, sha) of (id, text) with distinct known ids."""
    groups = {}
    for i, t in pairs:
        groups.setdefault(b"".join((t or "").encode().split()), []).append((i, t or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for i, _ in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm).hexdigest())
    return out


def rows_of(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_every_document(documents, rows):
    assert rows_of(stream_dedup.exact_duplicates(documents)) == brute(zip(rows.doc_id.tolist(), rows.text))


def test_state_over_several_batches(documents, rows):
    dealt = documents.repartition(6, "doc_id")
    assert rows_of(stream_dedup.exact_duplicates(dealt, files_per_batch=1)) == brute(zip(rows.doc_id.tolist(), rows.text))


def test_full_bytes_decide(documents, rows):
    weak = lambda norm: F.substring(F.sha2(norm.cast("binary"), 256), 1, 1)
    assert rows_of(stream_dedup.exact_duplicates(documents, digest=weak)) == brute(zip(rows.doc_id.tolist(), rows.text))


def test_awkward(spark, awkward, empty):
    from .conftest import TEXTS

    got = stream_dedup.exact_duplicates(awkward).toPandas()
    assert len(got) == len(TEXTS) + 3
    blank = got[got.doc_id.isin([2, 3, 4])]
    assert set(blank.keep_id) == {4} and set(blank.group_size) == {3} and blank.kept.sum() == 1
    first = got[got.doc_id.isin([0, 1])]
    assert set(first.keep_id) == {1} and set(first.group_size) == {3}  # the row with id 0 is there twice
    assert got.kept.sum() == len({"".join((t or "").split()) for t in [*TEXTS, "no id"]})  # one row of each group
    assert got[got.doc_id.isna()].kept.all()
    assert stream_dedup.exact_duplicates(empty).count() == 0


def test_ids_of_other_types_and_one_row_of_repeated_ones(spark):
    least = -(2**63)
    rows = [(least, "a b"), (5, "ab "), (5, "ab "), (7, "a  b"), (7, "a  b"), (None, "a  b")]
    got = stream_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    assert set(got.keep_id) == {7} and got.kept.sum() == 1 and got[got.kept].doc_id.tolist() == [7]
    got = stream_dedup.exact_duplicates(spark.createDataFrame([(least, "x"), (0, "x")], "doc_id bigint, text string")).toPandas()
    assert set(got.keep_id) == {least}
    named = spark.createDataFrame([("b", "x y"), ("a", "xy "), ("c", "z" * 3_000_000), ("d", "z" * 3_000_000)], "doc_id string, text string")
    assert rows_of(stream_dedup.exact_duplicates(named)) == brute([("b", "x y"), ("a", "xy "), ("c", "z" * 3_000_000), ("d", "z" * 3_000_000)])
