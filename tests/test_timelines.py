"""Drift-free rescaling in blocks: equal to one fold over the whole stream."""

import random

import pytest

from cuemill.functions.timebase import delta_step
from cuemill.operators import timelines

BASES = [((1, 1000), (1, 48_000), (1, 90_000)), ((1, 25), (1, 44_100), (1, 1000)), ((1, 1000), (1, 600), (1, 90_000)), ((1, 90_000), (1, 48_000), (1, 1000))]


def steps(rng, n, bases):
    """A stream that follows its durations, with jitter, jumps and packets without duration."""
    (a, b), (c, d), _ = bases
    at, out = 0, []
    for _ in range(n):
        duration = rng.choice([0, 1024, 1024, 1024, 960, 7])
        out.append((round(at * c * b / (d * a)) + rng.choice([0, 0, 0, 1, -1, 2]), duration))
        at += duration
        if rng.random() < 0.03:
            at += rng.randrange(100_000)
    return out


def fold(packets, bases, last=None):
    out = []
    for ts, duration in packets:
        value, last = delta_step(ts, duration, last, *bases)
        out.append(value)
    return out, last


@pytest.mark.parametrize("bases", BASES)
def test_a_block_as_a_function(bases):
    """For every state near and far from what the timestamps say, the function gives where the fold ends."""
    rng = random.Random(6)
    for _ in range(60):
        packets = steps(rng, rng.randint(1, 40), bases)
        e = timelines.Entry()
        for ts, duration in packets:
            e.step(ts, duration, bases)
        near = packets[0][0] * bases[0][0] * bases[1][1] // (bases[0][1] * bases[1][0])
        for state in [*range(near - 400, near + 400, 3), near - 10**7, near + 10**7, 0]:
            assert e(state) == fold(packets, bases, state)[1]
        assert len(e.values) <= 4 * len(packets) + 1 and e.cuts == sorted(e.cuts)


@pytest.mark.parametrize("block", [1, 3, 50, 1 << 16])
def test_blocks_against_one_fold(spark, block):
    rng = random.Random(9)
    bases = BASES[0]
    streams = {(f, s): steps(rng, n, bases) for f, s, n in ((1, 0, 300), (1, 1, 40), (2, 0, 1), (3, 5, 120))}
    rows = [(f, s, 2 * k + 1, ts, d) for (f, s), ps in streams.items() for k, (ts, d) in enumerate(ps)]
    df = spark.createDataFrame(rows, "file_id bigint, stream_index int, packet_index bigint, pts bigint, duration bigint").repartition(5)
    got = {(r.file_id, r.stream_index, r.packet_index): r.pts for r in timelines.rescale_delta(df, *bases, block=block).collect()}
    want = {(f, s, 2 * k + 1): v for (f, s), ps in streams.items() for k, v in enumerate(fold(ps, bases)[0])}
    assert got == want
