"""Classes of the near-duplicate stage against brute-force Jaccard similarity over all pairs."""

import random

import corpus_pipeline
from cuemill.llm import near_jaccard


def brute_set(text):
    words = [w.lower() for w in (text or "").encode().split()]
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_pairs(texts):
    sets = [brute_set(t) for t in texts]
    found = []
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 5 * common >= 4 * (len(a) + len(sets[j]) - common):
                found.append((j, i))
    return found


def brute_classes(texts):
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in brute_pairs(texts):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def varied(seed=3):
    """Texts with copies of which a few words are changed, chains of such copies, and a common passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for k in range(40):
        base = [word() for _ in range(rng.randrange(30, 300))] + (passage if k % 2 else [])
        texts.append(base)
        for _ in range(k % 6):
            base = list(base if k % 3 else texts[-1])
            for _ in range(rng.randrange(1, 1 + len(base) // 40 + 1)):
                base[rng.randrange(len(base))] = word()
            texts.append(base)
    return [" ".join(t) for t in texts]


def test_stage_keeps_one_of_each_class(spark, sf_dir):
    """Copies that differ in more than 4 bits of op4's fingerprint go too."""
    texts = varied()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    classes = brute_classes(texts)
    assert len(set(classes)) < len(texts) - 40
    assert sorted(r.doc_id for r in stage(spark, docs, sf_dir).collect()) == sorted(set(classes))


def test_every_document(documents, rows):
    got = near_jaccard.near_duplicates(documents).toPandas().set_index("doc_id").sort_index()
    assert got.component_id.tolist() == [rows.doc_id[i] for i in brute_classes(rows.text)]


def test_chunks_of_a_bucket_meet(spark, monkeypatch):
    """A large group of copies that are like their original but seldom like each other, in many small chunks."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = []
    for _ in range(300):
        words = list(base)
        for k in rng.sample(range(200), 4):
            words[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = brute_classes(texts)
    for volume in (250_000, 5_000):
        monkeypatch.setattr(near_jaccard, "CHUNK_VOLUME", volume)
        got = near_jaccard.near_duplicates(docs).toPandas().sort_values("doc_id")
        assert got.component_id.tolist() == expected


def test_awkward(awkward, empty):
    from .conftest import TEXTS

    got = near_jaccard.near_duplicates(awkward).toPandas()
    assert len(got) == len(TEXTS) + 3
    by_id = got[got.doc_id.notna()].drop_duplicates().set_index("doc_id")
    assert set(by_id.component_id[[2, 3, 4]]) == {2} and by_id.component_id[8] == 7 and by_id.component_id[1] == 0
    assert got[got.doc_id.isna()].component_id.isna().all()
    assert near_jaccard.near_duplicates(empty).count() == 0


def test_trees_give_candidates_that_are_checked(spark):
    """Without any band, fingerprints of at most 4 differing bits bring pairs together; only similar sets are linked."""
    sets = {1: range(10), 2: range(9), 3: range(50, 60), 4: range(10), 5: range(200, 230), 6: range(201, 230)}
    fps = {1: 0, 2: 0b1111, 3: 0b1, 4: -1, 5: 1 << 40, 6: 1 << 40}
    nodes = spark.createDataFrame([(k, len(v), [], fps[k]) for k, v in sets.items()], "node bigint, n int, bands array<bigint>, fp bigint")
    table = spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "node bigint, shingles array<bigint>")
    links = near_jaccard.near_links(nodes, lambda wanted: table.join(wanted, "node", "left_semi"))
    assert {frozenset(r) for r in links.collect()} == {frozenset((1, 2)), frozenset((5, 6))}
