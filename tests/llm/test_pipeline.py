"""The pipeline stage by stage: each stage's rows against the operator's verdicts worked out by brute force on its own input."""

from collections import Counter

import pytest

from . import test_mixing, test_near_jaccard, test_outliers, test_stream_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from cuemill.llm.storage import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        tables.append(docs)
    return [t.toPandas() for t in tables]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix", "pack"]
    assert all(list(t.columns) == list(stages[0].columns) for t in stages[:-1])
    assert list(stages[-1].columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_quality_stage(stages):
    kept = set(stages[1].doc_id)
    for i, text in zip(stages[0].doc_id, stages[0].text):
        n, *_, repeats = test_outliers.brute(text)
        if n < 50 or 100 * repeats > 50 * n:
            assert i not in kept
    symbols = {i: t[2] / max(1, t[0]) for i, t in ((i, test_outliers.brute(x)) for i, x in zip(stages[0].doc_id, stages[0].text))}
    assert all(symbols[i] < 0.5 for i in kept)


def test_exact_stage(stages):
    verdicts = test_stream_dedup.brute(zip(stages[1].doc_id.tolist(), stages[1].text))
    assert sorted(stages[2].doc_id) == sorted(i for i, v in verdicts.items() if v[2])


def test_near_stage(stages):
    docs = stages[2].sort_values("doc_id")
    classes = test_near_jaccard.brute_classes(docs.text.tolist())  # five words, similarity of 0.8 or more
    assert sorted(stages[3].doc_id) == sorted({docs.doc_id.iloc[c] for c in classes})


def test_mix_stage(spark, stages):
    from cuemill.llm.mixing import mixed

    docs = spark.createDataFrame(stages[3])
    got = test_mixing.check(docs, list(zip(stages[3].doc_id.tolist(), stages[3].text, stages[3].source)))
    assert Counter(stages[4].doc_id) == Counter({r.doc_id: r.copies for r in got.itertuples() if r.copies})
    assert mixed(docs).count() == len(stages[3])


def test_pack_stage(stages):
    last = stages[-1]
    assert Counter(last[last.piece == 0].doc_id) == Counter(stages[4].doc_id)
    for _, s in last.sort_values("offset").groupby("sequence_id"):
        ends = s.offset + s.length
        assert s.offset.tolist() == [0, *ends.tolist()[:-1]] and ends.max() <= 2048


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, stages[-1][key].values.tolist()))


@pytest.mark.parametrize("number", range(5))
def test_stages_take_awkward_rows(spark, awkward, empty, sf_dir, number):
    """Nulls in every column, repeated rows, extra columns; and an empty table."""
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, awkward, sf_dir).toPandas()
    if name != "pack":
        assert list(got.columns) == awkward.columns
    ids = Counter(got.doc_id.dropna().astype(int))
    if name == "quality_rules":
        assert not ids  # all have fewer than 50 words, or repeat themselves
    if name == "exact_dedup":
        assert ids == Counter([1, 4, 5, 6, 7, 9, 10])
    if name == "near_dedup":
        assert max(ids.values()) == 1 and ids[2] == 1 and not ids[3] and not ids[8]
    if name == "mix":
        assert max(ids.values()) <= 4  # a row that is there twice, twice each
    if name == "pack":
        assert set(ids) == set(range(11))
    assert stage(spark, empty, sf_dir).count() == 0


def test_rows_without_an_id_or_with_a_repeated_one(spark, sf_dir):
    """Each clean text keeps its row, whatever its id; rows alike in every column are one document."""
    import random

    rng = random.Random(7)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(100))
    texts = [prose() for _ in range(60)]
    rows = [(None if i < 5 else 7 if i < 10 else i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], rows[20]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for number, copies in ((0, 62), (1, 60), (2, 60)):
        got = corpus_pipeline.STAGES[number][1](spark, docs, sf_dir).toPandas()
        assert len(got) == copies and set(got.text) == set(texts)
    mixed = corpus_pipeline.mix(spark, docs, sf_dir).toPandas()
    assert set(mixed.text) == set(texts) and len(mixed) >= 62


def test_clashing_names_stay(spark):
    """Columns named like the stages' own, in either case and with a dot, come back as they were."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    rows = [(i, " ".join(words[(i * 7 + k * (1 + i % 5)) % 24] + str(k % (i + 3)) for k in range(80)), "en", "ab"[i % 2], 10, f"key{i}", i, -i, "x", f"d{i}") for i in range(12)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "_row_key", "_copies", "_COPY", "copies", "a.b"]
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == names, name
        found = [tuple(r) for r in got.collect()]
        assert found and set(found) <= set(rows), name
