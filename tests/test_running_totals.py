"""Running totals, sweeps and runs over groups that many tasks share."""

import random

from pyspark.sql import functions as F

from cuemill.operators import fingerprint, packets, sample_tables
from cuemill.operators.running_totals import running
from cuemill.sources import media


def test_running_totals_against_plain_loops(spark):
    rng = random.Random(3)
    rows = [(k, n, rng.randint(-5, 50) if rng.random() < 0.9 else None) for k in (None, "a", "b") for n in rng.sample(range(-300, 5000), 200)]
    df = spark.createDataFrame(rows, "k string, n bigint, v bigint")
    for reverse in (False, True):
        for combine, f in ((F.sum, sum), (F.max, max)):
            for inclusive in (False, True):
                got = {(r.k, r.n): r.t for r in running(df, ["k"], "n", {"t": F.col("v")}, 64, reverse, combine, inclusive).collect()}
                assert len(got) == len(rows)
                for k, n, _ in rng.sample(rows, 150):
                    seen = [v for k2, n2, v in rows if k2 == k and v is not None and (n2 > n if reverse else n2 < n) or (k2, n2) == (k, n) and inclusive and v is not None]
                    assert got[k, n] == (f(seen) if seen else None)


def test_one_long_stream_is_spread(spark):
    """Half a million packets of one stream are numbered by several tasks, none with more than two blocks."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(500_000).select(F.lit(1).alias("file_id"), F.lit(0).alias("stream_index"), F.col("id").alias("packet_index"), (F.col("id") % 7).alias("duration"))
        out = packets.number_frames(df).withColumn("task", F.spark_partition_id())
        r = out.agg(F.countDistinct("task").alias("tasks"), F.sum((F.col("frame_number") != F.col("packet_index")).cast("int")).alias("wrong"), F.max("running_pts").alias("last")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert r.tasks >= 3 and r.wrong == 0 and r.last == sum(k % 7 for k in range(499_999))


def test_bytes_behind(spark):
    df = spark.createDataFrame([(1, n, n + 1) for n in range(10)] + [(2, 0, 5)], "file_id bigint, packet_index bigint, size bigint")
    got = {(r.file_id, r.packet_index): r.after for r in fingerprint._with_bytes_after(df, ["file_id"]).collect()}
    assert got == {(1, n): sum(range(n + 2, 11)) for n in range(10)} | {(2, 0): 0}


def test_sweep_against_every_range(spark):
    """Overlapping, nested, empty and touching ranges; samples of no bytes; files without ranges."""
    rng = random.Random(8)
    ranges = [(f, s, s + rng.choice([0, 1, 40, 900])) for f in (1, 2) for s in (rng.randrange(3000) for _ in range(60))]
    samples = [(f, k, rng.randrange(3500), rng.choice([0, 1, 5, 60])) for f in (1, 2, 3) for k in range(200)] + [(1, 900, None, 4), (1, 901, 7, None)]
    df = spark.createDataFrame(samples, "file_id bigint, sample bigint, pos bigint, size bigint")
    r = spark.createDataFrame(ranges, "file_id bigint, start bigint, end bigint")
    want = {(f, k) for f, k, p, n in samples if p is not None and n is not None and any(f == g and a <= p and p + n <= b for g, a, b in ranges)}
    for block in (1, 100, 1 << 26):
        got = {(x.file_id, x.sample) for x in sample_tables.inside_ranges(df, r, True, block).collect()}
        out = {(x.file_id, x.sample) for x in sample_tables.inside_ranges(df, r, False, block).collect()}
        assert got == want and out == {(f, k) for f, k, *_ in samples} - want
    plan = sample_tables.inside_ranges(df, r)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hundred_thousand_ranges(spark):
    """A file with as many ranges as samples is swept once, not met range by range."""
    r = spark.range(100_000).select(F.lit(1).alias("file_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"))
    s = spark.range(100_000).select(F.lit(1).alias("file_id"), F.col("id").alias("sample"), (F.col("id") * 10 + F.col("id") % 4).alias("pos"), F.lit(6).cast("bigint").alias("size"))
    assert sample_tables.inside_ranges(s, r).count() == 75_000


def test_runs(spark):
    rng = random.Random(4)
    groups = {g: sorted(rng.sample(range(0, 40), rng.randint(1, 30))) for g in range(40)} | {None: [0, 1, 2, 4]}
    df = spark.createDataFrame([(g, n, f"x{n}") for g, ns in groups.items() for n in ns], "g int, number bigint, more string")
    for start in (0, 3):
        got = {}
        for r in media.contiguous_run(df, ["g"], "number", start).collect():
            got.setdefault(r.g, []).append((r.number, r.pts, r.more))
        for g, ns in groups.items():
            ns = [n for n in ns if n >= start]
            run = []
            if ns and ns[0] < start + 5:
                while ns and (not run or ns[0] == run[-1] + 1):
                    run.append(ns.pop(0))
            assert sorted(got.get(g, [])) == [(n, n - run[0], f"x{n}") for n in run]


def test_few_ranges_are_met_without_a_lambda(spark):
    """Lists of ranges are compared by compiled code; as many as are allowed, one more, none, and null places."""
    few = sample_tables.FEW_RANGES
    ranges = [(f, 10 * k, 10 * k + 5) for f, n in ((1, few), (2, few + 1), (3, 1)) for k in range(n)]
    samples = [(f, 0, i, None if i == 7 else 3 * i, 2) for f in (1, 2, 3, 4, None) for i in range(70)]
    r = spark.createDataFrame(ranges, "file_id bigint, start bigint, end bigint")
    s = spark.createDataFrame(samples, "file_id bigint, track int, sample bigint, pos bigint, size bigint")
    want = {(f, i) for f, _, i, pos, size in samples if pos is not None and any(f == g and a <= pos and pos + size <= b for g, a, b in ranges)}
    for inside in (True, False):
        found = sample_tables.inside_ranges(s, r, inside)
        assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = [(x.file_id, x.sample) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == (want if inside else {(f, i) for f, _, i, *_ in samples} - want)


def test_sample_tables_share_one_exchange(spark, sf_dir):
    """Sizes, durations and offsets are made of the same shuffled lines, behind the window that numbers them."""
    from cuemill.jobs import catalog

    plan = catalog.QUERIES["sample_timeline"](spark, sf_dir)._jdf.queryExecution().executedPlan()
    plan.execute().count()
    text = plan.toString().split("== Initial Plan ==")[0]
    shuffled = [line for line in text.splitlines() if "FileScan parquet" in line and "l_quantity" in line and "l_linenumber" in line]
    assert len(shuffled) == 1 and text.count("ReusedExchange") >= 2
