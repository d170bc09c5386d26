import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cuemill.llm import packing

PATH, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(PATH)


def best_fit(lengths, limit):
    import bisect

    free = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(i) if i < len(free) else limit) - n)
    return len(free)


@pytest.mark.parametrize("n", [0, 1, 7, 500, 20_000])
def test_plan(n):
    lengths = np.clip(np.random.default_rng(n).lognormal(6, 1, n).astype(int), 1, 2048).tolist()
    plan = packing.Plan(2048, Counter(lengths))
    placed = Counter()
    for length, _, many, *_ in plan.slots():
        placed[length] += many
    assert placed == Counter(lengths)
    assert all(sum(x * m for x, m in held) <= 2048 for _, held in plan.runs)
    assert sum(t for t, _ in plan.runs) <= 1.005 * best_fit(lengths, 2048) + 1


def test_patterns_fit_a_histogram():
    kinds = packing.patterns(8, 3)
    assert len(kinds) == len(set(kinds)) == 10 and all(sum(k) == 8 for k in kinds)
    a = np.zeros((8, len(kinds)))
    for i, k in enumerate(kinds):
        for b in k:
            a[b - 1, i] += 1
    x = packing.nnls(a, a @ np.arange(len(kinds), dtype=float))
    assert (x >= 0).all() and np.allclose(a @ x, a @ np.arange(len(kinds)), atol=1e-6)


def test_common_characters_are_read_alike():
    ids = packing.Ids(PATH, RANKS, P.PATTERN)
    for first in [*range(0, 0x378), *range(0x400, 0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]:
        for text in (f"a{chr(first)}1 {chr(first)}\n", f"  {chr(first)} {chr(first)}B", f"x{chr(first)}"):
            assert packing.COMMON.fullmatch(text)
            assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids, hex(first)


def check(got, texts):
    """Rows against brute force; texts by id, repeated ids as lists."""
    for i, versions in texts.items():
        part = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        expected = Counter()
        for text in versions:
            ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
            ends = sorted(range(len(ids), 0, -2048))  # the first piece may be the shorter one
            for k, (at, end) in enumerate(zip([0, *ends], ends)):
                piece = ids[at:end]
                expected[(k, at, len(piece), zlib.crc32(piece.tobytes()))] += 1
        assert Counter(zip(part.piece, part.start, part.length, part.ids_crc32)) == expected
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        ends = s.offset + s.length
        assert s.offset.tolist() == [0, *ends.tolist()[:-1]] and ends.max() <= 2048


def test_every_document(documents, rows):
    got = packing.pack(documents, PATH, 2048, 0, RANKS, P.PATTERN).toPandas()
    check(got, {i: [t] for i, t in zip(rows.doc_id.tolist(), rows.text)})
    assert got.sequence_id.nunique() <= best_fit(got.length.tolist(), 2048) + 1


def test_awkward(awkward, empty):
    from .conftest import TEXTS

    got = packing.pack(awkward, PATH, 2048, 0, RANKS, P.PATTERN).toPandas()
    texts = {i: [t] for i, t in enumerate(TEXTS)}
    texts[0].append(TEXTS[0]), texts[7].append(TEXTS[7])
    check(got, texts | {None: ["no id"]})
    assert packing.pack(empty, PATH, 2048, 0, RANKS, P.PATTERN).count() == 0
