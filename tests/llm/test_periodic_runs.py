import random
from hashlib import sha256
from zlib import crc32

import numpy as np

from cuemill.llm import periodic_runs as pr

from .conftest import TEXTS


def brute(words, min_length=6, min_exponent=4):
    """Every period: stretches in which words that far apart are alike, kept if no smaller period does for them."""
    n, out = len(words), []
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(min_length, min_exponent * p) and not any(all(words[i + k] == words[i + k + q] for k in range(length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    words = planted(doc_id, words) if plant and doc_id is not None else words
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(), sha256(kept).hexdigest())


def some(rng, n, letters):
    return np.array([rng.randrange(letters) for _ in range(n)])


def test_runs_against_every_period():
    rng = random.Random(5)
    for trial in range(400):
        x = some(rng, rng.randint(1, 60), rng.choice([1, 2, 3, 6]))
        for _ in range(rng.randint(0, 3)):
            unit = some(rng, rng.randint(1, 7), rng.choice([1, 2, 4]))
            x = np.concatenate([x, np.tile(unit, rng.randint(1, 8))[: rng.randint(1, 50)], some(rng, rng.randint(0, 9), 3)])
        for least, times in ((6, 4), (2, 2), (4, 3), (9, 2)):
            assert pr.runs_of(x, least, times) == brute(x.tolist(), least, times)
        assert pr.group_runs([x, x[::-1].copy(), np.zeros(0, np.int64), x], 6, 4) == [brute(v) for v in (x.tolist(), x[::-1].tolist(), [], x.tolist())]


def test_nested_and_overlapping():
    """A period of periods has runs at both levels."""
    inner = [1, 1, 1, 1, 1, 1, 2]
    x = np.array(inner * 5 + [3, 4] * 4 + [3])
    assert pr.runs_of(x) == brute(x.tolist()) and (0, 35, 7) in pr.runs_of(x) and (0, 6, 1) in pr.runs_of(x) and (35, 9, 2) in pr.runs_of(x)


def test_every_document_against_brute_force(documents, rows):
    got = {r.doc_id: tuple(r)[:8] for r in pr.periodic_runs(documents, plant=True).collect()}
    assert len(got) == len(rows)
    small = [(int(i), t) for i, t in zip(rows.doc_id, rows.text) if len((t or "").split()) <= 1500]
    assert len(small) > 0.9 * len(rows)
    for i, t in small:
        assert got[i] == row(i, t)
    assert sum(v[1] > 0 for v in got.values()) > len(got) / 40


def test_positions():
    rng = random.Random(2)
    for _ in range(3):
        xs = rng.sample(range(100_000), 6000)
        s, known = pr.Positions(xs[0]), [xs[0]]
        for k, x in enumerate(xs[1:]):
            if k % 500 == 0:
                known.sort()
                below, above = [y for y in known if y < x], [y for y in known if y > x]
                assert s.neighbours(x) == (max(below, default=-1), min(above, default=-1))
            s.add(x)
            known.append(x)
        assert list(s) == sorted(xs) and s.n == len(xs)


def test_very_long_texts(spark):
    """A word a quarter of a million times, and a long unit that repeats."""
    rng = random.Random(1)
    unit = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    got = {r.doc_id: r for r in pr.periodic_runs(spark.createDataFrame([(1, "a " * 250_000), (2, f"{unit} " * 5)], "doc_id bigint, text string")).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].n_dropped) == (1, 0, 250_000, 1, 249_999)
    assert (got[2].n_runs, got[2].length, got[2].period, got[2].exponent_milli) == (1, 100_000, 20_000, 5000)
    assert got[2].collapsed_sha256 == sha256(unit.encode()).hexdigest()


def test_awkward(awkward, empty):
    got = sorted(map(tuple, pr.periodic_runs(awkward, plant=True).collect()), key=str)
    want = [row(i, t) for i, t in [*enumerate(TEXTS), (0, TEXTS[0]), (7, TEXTS[7]), (None, "no id")]]
    assert sorted([g[:8] for g in got], key=str) == sorted(want, key=str)
    assert pr.periodic_runs(empty).count() == 0
