import numpy as np
import xxhash

from cuemill.llm import simhash
from cuemill.llm.components import components


def brute_print(text):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=4):
    """For each place the first place that its class reaches."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    p = np.array(prints, dtype=np.uint64)
    for i in range(len(p)):
        for j in np.nonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= radius)[0] + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(p))]


def test_every_document(documents, rows):
    got = simhash.near_duplicates(documents).toPandas().set_index("doc_id").sort_index()
    prints = [brute_print(t) for t in rows.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == [rows.doc_id[i] for i in brute_classes(prints)]


def clustered(n=3000, seed=5):
    """Random prints, chains of near ones, and a dense ball."""
    rng = np.random.default_rng(seed)
    points = list(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    flip = lambda p, k: p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    for start in points[:200]:
        for _ in range(5):
            start = flip(start, int(rng.integers(1, 6)))
            points.append(start)
    points += [flip(points[0], int(rng.integers(1, 4))) for _ in range(800)]
    return np.unique(np.array(points, dtype=np.uint64))


def test_sharded_links_are_exact(spark):
    points = clustered()
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    for shard_rows in (64, 700, 100_000):  # many shards, dense shards in several chunks, one shard
        got = {r.node: r.root for r in components(simhash.links(df, 4, shard_rows)).collect()}
        classes = brute_classes(points)
        groups = {}
        for p, c in zip(points.view(np.int64).tolist(), classes):
            groups.setdefault(got.get(p, p), set()).add(c)
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(classes))


def test_no_group_holds_all_visitors(spark):
    """Of fingerprints that visit one chunk no more than the set number meet it in a group, every own row meets each, and links stay exact."""
    from pyspark.sql import functions as F

    routed = spark.range(20_000).select(F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("chunk"), F.col("id").alias("fp"), (F.col("id") < 100).alias("own"))
    per = simhash.sliced(routed, 1000).groupBy("slice").agg(F.sum(F.col("own").cast("int")).alias("own"), F.sum((~F.col("own")).cast("int")).alias("visitors")).collect()
    assert len(per) == 20 and {r.own for r in per} == {100} and sum(r.visitors for r in per) == 19_900 and max(r.visitors for r in per) < 1300
    points = clustered(1500, 7)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    before, simhash.SLICE_CHUNKS = simhash.SLICE_CHUNKS, 1
    try:
        got = {r.node: r.root for r in components(simhash.links(df, 4, 32)).collect()}
    finally:
        simhash.SLICE_CHUNKS = before
    groups = {}
    for p, c in zip(points.view(np.int64).tolist(), brute_classes(points)):
        groups.setdefault(got.get(p, p), set()).add(c)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(brute_classes(points)))


def test_chunk_links_visitors():
    points = clustered(500, 9)
    own = np.arange(len(points)) % 3 != 0
    up = simhash.link_chunk(points, own, 4).roots()
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    for i, j in zip(*np.nonzero(near)):
        if own[i] or own[j]:
            assert up[i] == up[j]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (5, 5), (12, 10)] + [(20, k) for k in range(21, 60)] + [(k, k + 1) for k in range(100, 140)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert {got[k] for k in (1, 2, 3, 4)} == {1} and {got[k] for k in (10, 11, 12)} == {10}
    assert {got[k] for k in range(20, 60)} == {20} and {got[k] for k in range(100, 141)} == {100} and 5 not in got
    assert components(links.limit(0)).count() == 0


def test_awkward(awkward, empty):
    from .conftest import TEXTS

    got = simhash.near_duplicates(awkward).toPandas()
    assert len(got) == len(TEXTS) + 3
    by_id = got[got.doc_id.notna()].drop_duplicates().set_index("doc_id")
    assert set(by_id.component_id[[2, 3, 4]]) == {2} and set(by_id.fingerprint[[2, 3, 4]]) == {"0" * 16}
    assert by_id.component_id[8] == 7 and by_id.component_id[1] == 0
    assert got[got.doc_id.isna()].component_id.isna().all()
    assert simhash.near_duplicates(empty).count() == 0
