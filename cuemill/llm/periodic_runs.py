"""Periodic runs of words by Kruskal steps over suffix classes in decreasing LCP.

A run is a longest stretch of words with a smallest period ``q`` that repeats at least
``min_exponent`` times and has at least ``min_length`` words. Each suffix starts as a class
of its own, a set of one position. Neighbours in suffix order are united from the greatest
LCP down (union-find, the smaller set goes into the larger, sets stay ordered). When two
classes meet at an LCP of ``l``, a position of one that becomes the neighbour of a position
of the other at distance ``p <= l`` is a square: the words repeat with period ``p`` from the
first position for ``p + l`` words, and no smaller period does, since its position would
stand between the two already. It seeds a run, the run's first position where the word
before it doesn't continue the period, and ``p + l`` is then its whole length.

Documents stay in their rows: a task takes whole documents in groups bounded by words, so
nothing is shuffled and only documents with repeated word windows reach suffix ranks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of documents whose suffixes are ranked together; a longer document is a group of its own.
GROUP_WORDS = 400_000
#: Positions in a block of an ordered set, at most twice as many.
BLOCK = 512
SCHEMA = "doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


class Positions:
    """An ordered set of positions in blocks, so that insertion into a set of any size is cheap."""

    __slots__ = ("blocks", "lows", "n")

    def __init__(self, first: int):
        self.blocks, self.lows, self.n = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def neighbours(self, x: int) -> tuple[int, int]:
        """The positions before and after one that isn't in the set; -1 for none."""
        k = max(bisect_left(self.lows, x) - 1, 0)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else self.lows[k + 1] if k + 1 < len(self.lows) else -1
        return before, after

    def add(self, x: int) -> None:
        k = max(bisect_left(self.lows, x) - 1, 0)
        block = self.blocks[k]
        insort(block, x)
        self.lows[k] = block[0]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.lows[k : k + 1] = [block[0], block[BLOCK]]


def ranked(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of a sequence, and for every power of two the ranks of its windows of that many words.

    Windows that reach beyond the end are padded with rank 0, which no word has.
    """
    _, rank = np.unique(words, return_inverse=True)
    levels = [(rank + 1).astype(np.int32)]
    n, width = len(words), 1
    while len(levels[-1]) and levels[-1].max() < n:
        last = levels[-1].astype(np.int64)
        after = np.zeros(n, np.int64)
        if width < n:
            after[:-width] = last[width:]
        _, rank = np.unique(last * (n + 1) + after, return_inverse=True)
        levels.append((rank + 1).astype(np.int32))
        width *= 2
    return np.argsort(levels[-1], kind="stable"), levels


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefixes of the suffixes at ``a`` and ``b``, which differ."""
    n, length = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        equal = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        length += equal.astype(np.int64) << k
    return length


def runs_of(words: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs of a sequence of whole numbers as (start, length, period), ordered by start and period."""
    order, levels = ranked(words)
    a, b = order[:-1], order[1:]
    lcp = common(levels, a, b)
    # a run of period p has an LCP of at least (min_exponent - 1) p, and of min_length - p; neither is ever below `least`
    least = min(max((min_exponent - 1) * p, min_length - p) for p in range(1, min_length + 1))
    keep = np.flatnonzero(lcp >= max(least, 1))
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], sets[x] = x, Positions(x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []

    def seed(i: int, j: int, length: int) -> None:
        p = j - i
        if p * (min_exponent - 1) <= length and p + length >= min_length and (i == 0 or words[i - 1] != words[j - 1]):
            found.append((i, p + length, p))

    for x, y, length in zip(a[keep].tolist(), b[keep].tolist(), lcp[keep].tolist()):
        large, small = root(x), root(y)
        if sets[large].n < sets[small].n:
            large, small = small, large
        into, moved = sets[large], sets.pop(small)
        # neighbours are sought before anything is put in: pairs within one class aren't new
        places = [(z, *into.neighbours(z)) for z in moved]
        for k, (z, before, after) in enumerate(places):
            if before >= 0 and (k == 0 or places[k - 1][0] < before):
                seed(before, z, length)
            if after >= 0 and (k + 1 == len(places) or places[k + 1][0] > after):
                seed(z, after, length)
        for z, _, _ in places:
            into.add(z)
        parent[small] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def edited(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words with the contract's planted period: for one id in ten, the words from a place on repeat."""
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _suspects(ids: list[np.ndarray], width: int) -> np.ndarray:
    """Which sequences have a window of ``width`` words twice; a clash of hashes only costs a closer look."""
    lengths = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(ids)), lengths)
    out = np.zeros(len(ids), bool)
    m = len(flat) - width + 1
    if m <= 0:
        return out
    h = owner[:m].astype(np.uint64)
    for k in range(width):
        h = (h ^ flat[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = owner[:m] == owner[width - 1 :]
    h, owner = h[inside], owner[:m][inside]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out[owner[order[1:][same]]] = True
    return out


def group_runs(ids: list[np.ndarray], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of several sequences, whose suffixes are ranked together but never compared across sequences."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    least = min(max((min_exponent - 1) * p, min_length - p) for p in range(1, min_length + 1))
    suspects = np.flatnonzero(_suspects(ids, max(least, 1)))
    if not len(suspects):
        return out
    starts = np.concatenate([[0], np.cumsum([len(ids[k]) for k in suspects])])
    span = max(int(x.max()) for x in ids if len(x)) + 1
    flat = np.concatenate([ids[k].astype(np.int64) + i * span for i, k in enumerate(suspects)])
    for start, length, period in runs_of(flat, min_length, min_exponent):
        i = int(np.searchsorted(starts, start, side="right")) - 1
        out[suspects[i]].append((start - int(starts[i]), length, period))
    return out


def described(doc_id: object, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The row of a document."""
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept, dropped = words, 0
    if runs:
        gone = np.zeros(len(words), bool)
        for s, n, p in runs:
            gone[s + p : s + n] = True
        kept, dropped = [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())
    best = (None,) * 3
    for s, n, p in runs:
        if best[0] is None or (n * best[2], -s, -p) > (best[1] * p, -best[0], -best[2]):
            best = (s, n, p)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, milli, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest(), len(words), dropped


def periodic_runs(docs: DataFrame, plant: bool = False, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its runs' number and digest, its greatest run and the digest of its words without repeats.

    ``plant`` puts the contract's periods into one id in ten first. Null and empty texts
    have no words and no runs (four nulls, digests of nothing); a null id has no planted
    period; repeated rows have rows of their own; an empty table gives no rows; other
    columns are not looked at. The greatest run has the greatest exact length over period,
    then the smallest start, then the smallest period.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def of_group(group: list[tuple[object, list[bytes]]]) -> Iterator[tuple]:
        numbers: dict[bytes, int] = {}
        ids = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for _, words in group]
        for (doc_id, words), runs in zip(group, group_runs(ids, min_length, min_exponent)):
            yield described(doc_id, words, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, group, total = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split()
                if plant:
                    words = edited(doc_id, words)
                group.append((doc_id, words))
                total += len(words)
                if total >= GROUP_WORDS:
                    out += of_group(group)
                    group, total = [], 0
            out += of_group(group)
            first = batch.schema.field(0).type
            types = [first, *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in SCHEMA.format(kind="x").split(", ")])

    return rows.mapInArrow(run, SCHEMA.format(kind=kind))
