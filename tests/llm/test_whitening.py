import numpy as np

from cuemill.llm import whitening as wh


def table(spark, x, ids=None, more=()):
    rows = [(i, [float(e) for e in r], 0) for i, r in zip(ids or range(len(x)), np.asarray(x))] + list(more)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component int")


def brute(x, most=32):
    """Eigenvectors of the covariance of exact whole numbers."""
    v = np.floor(64 * np.asarray(x, np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(v), v.sum(0)
    whole = v * n - s
    c = whole / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    return n, (whole.astype(object) ** 2).sum(1), (c @ w / np.sqrt(np.maximum(e, 1e-300)))[:, :most], (e / e.sum())[:most]


def wide(df):
    p = df.toPandas()
    z = p.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    return p, z.to_numpy()


def check(p, z, x, most=32, rtol=1e-6):
    n, deviation, white, explained = brute(x, most)
    assert (p.n == n).all() and len(p) == len(x) * white.shape[1]
    one = p[p.component == 1].set_index("vec_id").sort_index()
    assert one.deviation.tolist() == deviation.tolist()
    assert np.allclose(p[p.vec_id == p.vec_id.min()].sort_values("component").explained, explained, rtol=1e-9)
    sign = np.sign((z * white).sum(0))
    assert np.allclose(z, white * sign, rtol=rtol, atol=1e-6)
    assert np.abs(z.T @ z / n - np.eye(z.shape[1])).max() < 1e-8
    assert p.identity_error.nunique() == 1 and p.identity_error.iloc[0] < 1e-8


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = np.array(df.orderBy("vec_id").toPandas().embedding.tolist())
    check(*wide(wh.whitened(df)), x)


def test_ill_conditioned(spark):
    """Spreads from 300 to 0.05 along nearly dependent columns: shifted, then repeated."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 12)) * np.geomspace(3e4, 5, 12)
    x = a @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 500
    check(*wide(wh.whitened(table(spark, x))), x, rtol=1e-4)


def test_dependent_constant_and_few(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (60, 5)).astype(float)
    x = np.column_stack([x, x[:, 0], np.full(60, 3.0)])  # a column twice, a constant one
    p, z = wide(wh.whitened(table(spark, x)))
    assert np.isnan(z[:, 5:]).all() and not np.isnan(z[:, :5]).any()
    assert np.abs(z[:, :5].T @ z[:, :5] / 60 - np.eye(5)).max() < 1e-8 and (p.identity_error < 1e-8).all()
    assert (p[p.component > 5].explained == 0).all()
    few = wh.whitened(table(spark, x[:3])).toPandas()  # fewer rows than dimensions
    assert len(few) == 21 and few[few.component <= 2].whitened.notna().all() and few[few.component > 2].whitened.isna().all()
    one = wh.whitened(table(spark, x[:1])).toPandas()
    assert len(one) == 7 and one.whitened.isna().all() and one.explained.isna().all() and (one.deviation == 0).all() and (one.identity_error == 0).all()


def test_number_of_components_and_large_offset(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 40)) + 8000.0
    p, z = wide(wh.whitened(table(spark, x)))
    assert z.shape == (200, 32)
    check(p, z, x)


def test_awkward(spark):
    x = np.random.default_rng(4).normal(size=(50, 3))
    nan, inf = float("nan"), float("inf")
    bad = [(900, None, 0), (901, [1.0, None, 2.0], 0), (902, [nan, 1.0, 1.0], 0), (903, [inf, 1.0, 1.0], 0), (904, [-inf, 1.0, 1.0], 0), (905, [1.0], 0), (906, [], 0), (907, [3e38, 1.0, 1.0], 0)]
    p, z = wide(wh.whitened(table(spark, x, more=bad)))
    check(p, z, x)
    assert set(p.vec_id) == set(range(50))
    same = [(None, [1.0, 2.0, 3.0], 0)] * 2 + [(1, [1.0, 2.0, 3.0], 0), (1, [4.0, 4.0, 9.0], 0)]
    got = wh.whitened(spark.createDataFrame(same, "vec_id bigint, embedding array<float>, component int")).toPandas()
    assert len(got) == 12 and got.vec_id.isna().sum() == 6
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert wh.whitened(none).count() == 0 and wh.whitened(none).columns == got.columns.tolist()
    assert wh.whitened(table(spark, [], more=bad[:5])).count() == 0


def test_one_vector_a_third_of_all(spark):
    x = np.random.default_rng(5).normal(size=(300, 6))
    x[:100] = x[0]
    check(*wide(wh.whitened(table(spark, x))), x)
