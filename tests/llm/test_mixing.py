import hashlib
import re

from cuemill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Reshare the excess round by round until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(full.values())
        got = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if got[s] > most * sizes[s]]
        if not over:
            return full | got
        full |= {s: most * sizes[s] for s in over}


def check(df, pairs):
    got = mixing.mixed(df).toPandas()
    sizes = {}
    for _, text, source in pairs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = brute_targets(sizes)
    sources = {i: s for i, _, s in pairs}
    largest = {}
    for i, text, s in pairs:
        largest[s] = max(largest.get(s, 0), len(WORD.findall(text or "")))
    assert len(got) == len(pairs)
    taken = {}
    for r in got.itertuples():
        s = sources[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert abs(r.target - targets[s]) < 1e-6 * max(1, targets[s]) and r.source_size == sizes[s]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    return got


def test_every_document(documents, rows):
    pairs = list(zip(rows.doc_id.tolist(), rows.text, rows.source))
    got = check(documents, pairs)
    again = mixing.mixed(documents.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()


def test_smallest_ranking_values_are_taken(documents, rows):
    got = mixing.mixed(documents).toPandas().set_index("doc_id")

    def u(i):
        return (int(hashlib.md5(f"20:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    rows = rows.assign(u=[u(i) for i in rows.doc_id], copies=[got.copies[i] for i in rows.doc_id])
    for _, part in rows.groupby("source"):
        low, high = part.copies.min(), part.copies.max()
        if low != high:
            assert part.u[part.copies == high].max() < part.u[part.copies == low].min()


def test_awkward(spark, awkward, empty):
    from .conftest import TEXTS

    got = mixing.mixed(awkward).toPandas()
    assert len(got) == len(TEXTS) + 3 and (got.taken <= 2 * got["size"]).all() and not got.target.isna().any()
    assert mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert {(r.taken, r.target) for r in mixing.mixed(blank).collect()} == {(0, 0.0)}
