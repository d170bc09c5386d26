import random
from collections import Counter

import duckdb
import numpy as np

from cuemill.llm import outliers
from cuemill.llm.sql import outliers_sql
from cuemill.llm.storage import materialise


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_every_document_against_brute_force_and_sql(spark, documents, rows, sf_dir):
    got = outliers.quality(documents).toPandas().set_index("doc_id").sort_index()
    for i, text in zip(rows.doc_id, rows.text):
        e = brute(text)
        assert tuple(got.loc[i, NAMES]) == e
        assert got.base_failed[i] == (e[0] < 50 or 100 * e[4] > 50 * e[0])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    sql = con.sql(outliers_sql()).df().set_index("doc_id").sort_index()
    assert sql.kept.tolist() == got.kept.tolist()


def sample(spark, blocks, seed=3):
    """Normal blocks (rows, centre, spread) as one group."""
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(m, s, (n, 4)) for n, m, s in blocks])
    return x, spark.createDataFrame([("g", i % outliers.PARTS, *map(float, r)) for i, r in enumerate(x)], ["grp", "part", *outliers.NAMES])


def test_estimates_resist_outliers(spark):
    """Two thirds from one normal distribution, one third far away: the estimate is that of the two thirds."""
    _, df = sample(spark, [(2000, [1, 2, 3, 4], [0.3, 0.5, 0.6, 0.7]), (1000, 30, 1)])
    fit = outliers.estimates(df).first()
    assert np.allclose([fit[f"m_{i}"] for i in range(4)], [1, 2, 3, 4], atol=0.1)
    rows = outliers._distance(df.join(spark.createDataFrame([fit]), "grp")).toPandas()
    far = rows.x_word > 15  # a join doesn't keep the order of rows
    assert far.sum() == 1000 and (rows.d[~far] < outliers.CUTOFF).mean() > 0.99 and (rows.d[far] > outliers.CUTOFF).all()


def log_det(x):
    floors = np.diag([f * f for f in outliers.FLOORS.values()])
    return np.linalg.slogdet(outliers.CONSISTENCY * np.cov(x.T, bias=True) + floors)[1]


def test_smallest_determinant_and_its_scatter(spark):
    """No determinant rises from step to step, the result's is the least of all starts, no random half has a smaller one, and the scatter is right for normal data."""
    x, df = sample(spark, [(1500, [1, 2, 3, 4], [0.5, 0.9, 1.1, 1.3]), (500, [4, 2, 3, 9], 0.3)])
    fits = [outliers._starts(df)]
    for _ in range(6):
        fits.append(outliers.concentrated(df, materialise(fits[-1], "test")))
    dets = [dict(f.select("start", "log_det").collect()) for f in fits[1:]]
    assert set(dets[0]) == {0, 1, 2, 3}
    for before, after in zip(dets, dets[1:]):
        assert all(after[k] <= before[k] + 0.02 for k in before)  # ranges hold a little more than half
    best = outliers.estimates(df).first()
    assert best.log_det <= min(dets[-1].values()) + 1e-6
    rng = np.random.default_rng(1)
    assert all(log_det(x[rng.permutation(len(x))[:1000]]) > best.log_det for _ in range(50))
    lower = np.array([[best[f"l_{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    spread = np.sqrt(np.diag(lower @ lower.T) - np.square(list(outliers.FLOORS.values())))
    assert np.allclose(spread, [0.5, 0.9, 1.1, 1.3], rtol=0.25)


def test_documents_labelled_good_stay(spark, documents, sf_dir):
    """Of labelled documents past the base rules, 97 in a hundred good ones stay and as many bad ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = outliers.quality(documents).where("not base_failed").join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.03


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(4)
    clean = [(i, prose(rng, rng.randint(60, 400)), "en", "a") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "$$$&&&" for w in prose(rng, 200).split()), "en", "a") for i in range(40)]
    got = outliers.quality(spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert got.kept[[r[0] for r in clean]].all() and not got.kept[[r[0] for r in junk]].any()


def test_awkward(awkward, empty):
    from .conftest import TEXTS

    got = outliers.quality(awkward).toPandas()
    assert len(got) == len(TEXTS) + 3 and not got.kept.isna().any()
    for i, t in enumerate(TEXTS):
        assert {tuple(x) for x in got[got.doc_id == i][NAMES].values} == {brute(t)}
    assert outliers.quality(empty).count() == 0
