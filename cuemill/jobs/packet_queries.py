"""Queries over packets: statistics, filters, time arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timebase as tb
from ..operators import packets as P
from ..operators import probe
from ..sources import adapters, media
from .fragments import EVENT_PACKETS, FILES, micros_text, pcm, rounded
from .registry import query, table, working_folder

SLOTS = 256


def event_packets(spark, sf_dir):
    return adapters.packets_from_events(table(spark, sf_dir, "events"))


@query(f"WITH {FILES}, {pcm(SLOTS * 2)}, d AS (SELECT *, size // 2 AS duration, md5(payload) AS digest FROM q) SELECT file_id, count(*) AS packets, sum(size)::BIGINT AS bytes, sum(duration)::BIGINT AS duration, (max(packet_index) * {SLOTS})::BIGINT AS last_pts, min(digest) AS least_digest, max(digest) AS most_digest FROM d GROUP BY file_id")
def packet_fingerprint_stats(spark, sf_dir):
    """Raw audio packets of every file, fingerprinted where they are cut, then summed per file."""
    files = adapters.files_from_documents(table(spark, sf_dir, "documents"))
    rows = media.packetize_pcm(files, 1, SLOTS).withColumn("digest", F.md5("payload"))
    return rows.groupBy("file_id").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"), F.sum("duration").alias("duration"), F.max("pts").alias("last_pts"), F.min("digest").alias("least_digest"), F.max("digest").alias("most_digest"))


@query(f"WITH {FILES}, {pcm(SLOTS * 2)} SELECT file_id, packet_index, packet_index * {SLOTS} AS pts, size // 2 AS duration, size, md5(payload) AS digest FROM q")
def pcm_framehash(spark, sf_dir):
    """MD5 of every raw audio packet."""
    files = adapters.files_from_documents(table(spark, sf_dir, "documents"))
    return media.packetize_pcm(files, 1, SLOTS).select("file_id", "packet_index", "pts", "duration", "size", F.md5("payload").alias("digest"))


@query(f"WITH {FILES}, {pcm(12).replace('FROM f', 'FROM f WHERE length % 12 = 0')} SELECT file_id, packet_index AS pts, size, md5(payload) AS digest FROM q")
def rawvideo_frames(spark, sf_dir):
    """Whole 12-byte frames of files that divide into them."""
    files = adapters.files_from_documents(table(spark, sf_dir, "documents"))
    return media.packetize_rawvideo(files, 12)[0].select("file_id", "pts", "size", F.md5("payload").alias("digest"))


@query(f"WITH {FILES} SELECT file_id, 'rawvideo' AS stage, 'InvalidData' AS error_kind, 'length ' || length || ' is no multiple of the frame size 12' AS error FROM f WHERE length % 12 != 0")
def rawvideo_quarantine(spark, sf_dir):
    """Files that don't divide into frames, as quarantine rows."""
    return media.packetize_rawvideo(adapters.files_from_documents(table(spark, sf_dir, "documents")), 12)[1]


@query(
    f"""WITH {EVENT_PACKETS}, g AS (
  SELECT file_id, stream_index, count(*) AS packets, sum(size)::BIGINT AS bytes, sum(duration)::BIGINT AS duration, arg_max(pts, packet_index) AS last_pts, arg_max(dts, packet_index) AS last_dts FROM p GROUP BY file_id, stream_index
), e AS (SELECT file_id, unnest(range(0, max(stream_index) + 1)) AS stream_index FROM g GROUP BY file_id)
SELECT e.file_id, e.stream_index, coalesce(packets, 0) AS packets, coalesce(bytes, 0) AS bytes, coalesce(duration, 0) AS duration, last_pts, last_dts FROM e LEFT JOIN g ON e.file_id = g.file_id AND e.stream_index = g.stream_index"""
)
def stream_stats(spark, sf_dir):
    """Dense per-stream statistics."""
    return P.stream_stats(event_packets(spark, sf_dir))


@query(f"WITH {EVENT_PACKETS} SELECT file_id, stream_index, grouping(file_id, stream_index)::BIGINT AS level, count(*) AS packets, sum(size)::BIGINT AS bytes, sum(duration)::BIGINT AS duration FROM p GROUP BY ROLLUP (file_id, stream_index)")
def total_stats(spark, sf_dir):
    """Statistics per stream, per file and over all."""
    return P.total_stats(event_packets(spark, sf_dir))


@query(f"WITH {EVENT_PACKETS}, s AS (SELECT file_id, stream_index FROM (SELECT DISTINCT user_id AS file_id FROM events), k) SELECT s.file_id, s.stream_index, count(p.file_id) AS nb_read_packets FROM s LEFT JOIN p ON s.file_id = p.file_id AND s.stream_index = p.stream_index GROUP BY s.file_id, s.stream_index")
def count_packets(spark, sf_dir):
    """Packets read per declared stream; every file declares a stream of every kind."""
    events = table(spark, sf_dir, "events")
    kinds = [r.stream_index for r in adapters.numbered_kinds(events, "event_type", "stream_index").select("stream_index").collect()]
    streams = events.select(F.col("user_id").alias("file_id")).distinct().withColumn("stream_index", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return P.count_packets(streams, event_packets(spark, sf_dir))


@query("SELECT l_orderkey AS file_id, count(*) AS nb_frames, count(*) AS nb_read_frames FROM lineitem GROUP BY l_orderkey")
def count_frames(spark, sf_dir):
    """Frame counts as the container states them."""
    return P.count_frames(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.count("*").alias("nb_frames")))


@query(f"WITH {EVENT_PACKETS} SELECT file_id, packet_index, stream_index, row_number() OVER w - 1 AS frame_number, coalesce(sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS running_pts FROM p WINDOW w AS (PARTITION BY file_id, stream_index ORDER BY packet_index)")
def frame_numbers(spark, sf_dir):
    """Frame numbers and running timestamps per stream."""
    return P.number_frames(event_packets(spark, sf_dir)).select("file_id", "packet_index", "stream_index", "frame_number", "running_pts")


@query(f"WITH {EVENT_PACKETS} SELECT file_id, packet_index, CASE WHEN flags & 1 != 0 THEN 'K' ELSE '_' END || '__' AS flags_text FROM p")
def packet_flags(spark, sf_dir):
    """Flag text of every packet."""
    return event_packets(spark, sf_dir).select("file_id", "packet_index", P.flags_text(F.col("flags")).alias("flags_text"))


@query(f"WITH {EVENT_PACKETS} SELECT file_id, packet_index, size FROM p WHERE flags & 1 != 0 AND flags & 4 = 0")
def key_packets(spark, sf_dir):
    """Key packets that aren't discarded."""
    return P.filter_packets(event_packets(spark, sf_dir), key_only=True, drop_discarded=True).select("file_id", "packet_index", "size")


@query(f"WITH {EVENT_PACKETS} SELECT file_id, packet_index, pts, row_number() OVER (ORDER BY file_id, packet_index) - 1 AS place FROM p")
def write_order(spark, sf_dir):
    """The total packet order, with each packet's place in it: counts per file, then places within."""
    rows = event_packets(spark, sf_dir)
    sizes = rows.groupBy("file_id").agg(F.count("*").alias("n"))
    return P.in_write_order(rows.join(first_places(spark, sizes), "file_id").select("file_id", "packet_index", "pts", (F.col("base") + F.col("packet_index")).alias("place")))


def first_places(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """``file_id, base``: the rows of all earlier files, from ``file_id, n``; files are dealt by ranges, and only a number per range is summed in one place."""
    folder = working_folder(spark, "places")
    sizes.repartitionByRange("file_id").withColumn("part", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.schema("file_id " + sizes.schema["file_id"].dataType.simpleString() + ", n bigint, part int").parquet(folder)
    parts = dealt.groupBy("part").agg(F.sum("n").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("file_id")) - F.col("n")
    return dealt.withColumn("within", within).join(before, "part").select("file_id", (F.col("before") + F.col("within")).alias("base"))


@query(f"WITH {EVENT_PACKETS}, t AS (SELECT file_id, packet_index, codec FROM p JOIN (SELECT event_type, CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'audio' ELSE 'data' END AS codec FROM k) USING (event_type)) SELECT file_id, packet_index, codec AS codec_type FROM t")
def packets_with_streams(spark, sf_dir):
    """Packets joined with their stream's attributes."""
    packets = event_packets(spark, sf_dir)
    streams = packets.select("file_id", "stream_index", "event_type").distinct().withColumn("codec_type", F.when(F.col("event_type") == "view", "video").when(F.col("event_type") == "click", "audio").otherwise("data"))
    return P.join_streams(packets, streams, ["codec_type"]).select("file_id", "packet_index", "codec_type")


@query(f"WITH {EVENT_PACKETS} SELECT file_id, packet_index, stream_index FROM p WHERE stream_index > 1")
def orphan_packets(spark, sf_dir):
    """Packets of streams that nobody declared (here only streams 0 and 1 are)."""
    packets = event_packets(spark, sf_dir)
    return P.orphan_packets(packets, packets.where("stream_index <= 1").select("file_id", "stream_index").distinct()).select("file_id", "packet_index", "stream_index")


@query(f"WITH {EVENT_PACKETS} SELECT file_id, packet_index, {rounded('pts::HUGEINT * 90000', '1000000', 'near')} AS pts, {rounded('dts::HUGEINT * 90000', '1000000', 'near')} AS dts, CASE WHEN duration > 0 THEN {rounded('duration::HUGEINT * 90000', '1000000', 'near')} ELSE duration END AS duration FROM p")
def rescaled_packets(spark, sf_dir):
    """Packet times from microseconds to 1/90000."""
    return P.rescale_packets(event_packets(spark, sf_dir), (1, 1_000_000), (1, 90_000)).select("file_id", "packet_index", "pts", "dts", "duration")


_V = "(l_partkey * 7919 - l_suppkey * 104729)"


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, {', '.join(f'{rounded(f'{_V}::HUGEINT * (l_linenumber * 1001)', '(l_suppkey + 3)', m)} AS r_{m}' for m in ('zero', 'inf', 'down', 'up', 'near'))} FROM lineitem")
def rescale_modes(spark, sf_dir):
    """One product and quotient in all five roundings."""
    v = F.col("l_partkey") * 7919 - F.col("l_suppkey") * 104729
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[tb.rescale(v, F.col("l_linenumber").cast("bigint") * 1001, F.col("l_suppkey") + 3, m).alias(f"r_{m}") for m in (tb.ZERO, tb.INF, tb.DOWN, tb.UP, tb.NEAR)])


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, {rounded(f'{_V}::HUGEINT * 1001 * 48000', '30000::HUGEINT * l_linenumber', 'near')} AS ticks, CASE WHEN l_linenumber % 2 = 0 THEN 9223372036854775807 ELSE {rounded(f'{_V}::HUGEINT * 1001 * 48000', '30000::HUGEINT', 'down')} END AS kept FROM lineitem")
def rescale_time_base(spark, sf_dir):
    """Ticks between rational time bases; extreme values pass through where asked."""
    v = F.col("l_partkey") * 7919 - F.col("l_suppkey") * 104729
    src = F.struct(F.lit(1001).alias("num"), F.lit(30000).alias("den"))
    dst = F.struct(F.col("l_linenumber").alias("num"), F.lit(48000).alias("den"))
    w = F.when(F.col("l_linenumber") % 2 == 0, F.lit(tb.MAX)).otherwise(v)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tb.rescale_q(v, src, dst).alias("ticks"), tb.rescale_q(w, (1001, 30000), (1, 48000), tb.DOWN, True).alias("kept"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, sign(l_partkey::HUGEINT * 1001 * 25 - l_suppkey::HUGEINT * 30000)::BIGINT AS cmp, (l_partkey::HUGEINT * 1001 * 3)::BIGINT AS sort_key FROM lineitem")
def compare_timestamps(spark, sf_dir):
    """Exact comparison across time bases, and a common sort key."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tb.compare_ts(F.col("l_partkey"), (1001, 30000), F.col("l_suppkey"), (1, 25)).alias("cmp"), tb.order_key(F.col("l_partkey"), (1001, 30000), 90000).alias("sort_key"))


@query("SELECT o_orderkey, m, CASE WHEN d * 2 > m THEN d - m ELSE d END AS distance FROM (SELECT o_orderkey, m, ((o_custkey - o_orderkey) % m + m) % m AS d FROM (SELECT *, 1024::BIGINT AS m FROM orders))")
def wrapped_clock_distance(spark, sf_dir):
    """Signed distance of two counters modulo 1024."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1024).alias("m"), tb.compare_mod(F.col("o_custkey"), F.col("o_orderkey"), 1024).alias("distance"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, (l_partkey // g) || '/' || (l_suppkey // g) AS ratio FROM (SELECT *, greatest(gcd(l_partkey, l_suppkey), 1) AS g FROM lineitem)")
def reduced_ratios(spark, sf_dir):
    """Ratios in lowest terms."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tb.reduce_ratio(F.col("l_partkey"), F.col("l_suppkey")).alias("ratio"))


def _sql_rational(n: str, d: str, name: str) -> str:
    """Lowest terms, null where a part has more than 32 bits."""
    n, d = f"(({n}) // gcd({n}, {d}))::BIGINT", f"(({d}) // gcd({n}, {d}))::BIGINT"
    fits = f"{n} BETWEEN -2147483648 AND 2147483647 AND {d} <= 2147483647"
    return f"CASE WHEN {fits} THEN {n} END AS {name}_num, CASE WHEN {fits} THEN {d} END AS {name}_den"


_A, _B, _C = "(l_linenumber + 1)::BIGINT", "(l_suppkey + 2)::BIGINT", "(l_partkey + 1)::BIGINT"


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, {_sql_rational(f'{_A} * {_C} + {_B}', f'{_B} * {_C}', 's')}, {_sql_rational(f'{_A}', f'{_B} * {_C}', 'p')}, {_sql_rational(f'{_A} * {_C}', f'{_B}', 'q')}, sign({_A} * {_C} - {_B})::BIGINT AS cmp FROM lineitem")
def rational_arithmetic(spark, sf_dir):
    """Sum, product, quotient and comparison of fractions; a result whose lowest terms have more than 32 bits is null."""
    a = F.struct((F.col("l_linenumber") + 1).alias("num"), (F.col("l_suppkey") + 2).alias("den"))
    b = F.struct(F.lit(1).alias("num"), (F.col("l_partkey") + 1).alias("den"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tb.add(a, b).alias("s"), tb.multiply(a, b).alias("p"), tb.divide(a, b).alias("q"), tb.compare(a, b).alias("cmp"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "spq" for y in ("num", "den")], "cmp")


#: In doubles all candidates that may be nearest, then exactly: the double is n / 2^s; distances |n q - p 2^s| / q that differ do so by at least 1 / 1000000, so that two millionths of them as whole numbers order them.
_NEAREST = """WITH v AS (SELECT o_orderkey, v, 62 - CASE WHEN v = 0 THEN 0 ELSE greatest(floor(log2(v))::INT, 0) END AS s FROM (SELECT o_orderkey, o_totalprice::DOUBLE / 97 AS v FROM orders)),
c AS (SELECT *, least(1000, floor(v * q + 0.4999999))::BIGINT AS a, least(1000, floor(v * q + 0.5000001))::BIGINT AS b FROM (SELECT *, unnest(range(1, 1001)) AS q FROM v)),
w AS (SELECT o_orderkey, v, s, q, a AS p FROM c UNION ALL SELECT o_orderkey, v, s, q, b FROM c WHERE a != b),
k AS (SELECT o_orderkey, p::HUGEINT AS p, q::HUGEINT AS q, floor(v * pow(2::DOUBLE, s) + 0.5)::HUGEINT AS n, 1::HUGEINT << s AS d FROM w QUALIFY abs(v - p::DOUBLE / q) <= min(abs(v - p::DOUBLE / q)) OVER (PARTITION BY o_orderkey) + 1e-9)
SELECT o_orderkey, p::BIGINT AS num, q::BIGINT AS den FROM k QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(n * q - p * d) * 2000000 // q, q, p) = 1"""


@query(_NEAREST)
def bounded_rationals(spark, sf_dir):
    """Best fractions for doubles with parts up to 1000: of all the one that comes nearest, exactly; of equals that of least denominator, then numerator."""
    v = F.col("o_totalprice") / 97
    return table(spark, sf_dir, "orders").select("o_orderkey", tb.rational_from_double(v, 1000).alias("r")).select("o_orderkey", "r.num", "r.den")


@query(f"WITH {EVENT_PACKETS} SELECT file_id, packet_index, {micros_text('duration', '1', '1000000')} AS duration_time, {micros_text('(pts - 1700000000000000)', '1001', '30000000')} AS shifted_time FROM p")
def formatted_times(spark, sf_dir):
    """Times as text with six decimals, negative ones included."""
    return event_packets(spark, sf_dir).select("file_id", "packet_index", tb.format_time(F.col("duration"), (1, 1_000_000)).alias("duration_time"), tb.format_time(F.col("pts") - 1_700_000_000_000_000, (1001, 30_000_000)).alias("shifted_time"))


@query("SELECT o_orderkey, text, CASE WHEN o_custkey > 0 THEN o_custkey * 1001 // gcd(o_custkey * 1001, d) END::BIGINT AS num, CASE WHEN o_custkey > 0 THEN d // gcd(o_custkey * 1001, d) END::BIGINT AS den FROM (SELECT *, (o_custkey * 1001) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/' || 1001 END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 1001 END AS d FROM orders)")
def rates_from_text(spark, sf_dir):
    """Frame rates parsed from text."""
    rows = table(spark, sf_dir, "orders").withColumn("text", F.concat((F.col("o_custkey") * 1001).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("/1001")))
    return rows.select("o_orderkey", "text", tb.rate_from_text(F.col("text")).alias("r")).select("o_orderkey", "text", "r.num", "r.den")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, ((l_suppkey + 1) // g) || ':' || (l_linenumber // g) AS sar, (w // h) || ':' || (v // h) AS dar FROM (SELECT *, gcd(l_suppkey + 1, l_linenumber) AS g, 1920 * (l_suppkey + 1) AS w, 1080 * l_linenumber AS v, gcd(1920 * (l_suppkey + 1), 1080 * l_linenumber) AS h FROM lineitem)")
def aspect_ratios(spark, sf_dir):
    """Sample and display aspect ratios."""
    h, v = F.col("l_suppkey") + 1, F.col("l_linenumber").cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", probe.sample_aspect_ratio(h, v).alias("sar"), probe.display_aspect_ratio(F.lit(1920), F.lit(1080), h, v).alias("dar"))


_RATES = ((24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60, 1))


@query("WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {n}, {d})" for i, (n, d) in enumerate(_RATES)) + ") t(i, n, d)), x AS (SELECT o_orderkey, i, row_number() OVER (PARTITION BY o_orderkey ORDER BY (abs((o_custkey % 70) * d * 7 - n * 7)::HUGEINT * 30030) // d, i) AS r FROM orders, c) SELECT o_orderkey, i::BIGINT AS nearest FROM x WHERE r = 1")
def nearest_rates(spark, sf_dir):
    """The standard frame rate nearest to a measured one."""
    rate = F.struct(((F.col("o_custkey") % 70) * 7).alias("num"), F.lit(7).alias("den"))
    return table(spark, sf_dir, "orders").select("o_orderkey", probe.nearest_rate(rate, _RATES).alias("nearest"))


@query("SELECT l_orderkey AS file_id, count(*) AS samples, sum(l_suppkey + 1)::BIGINT AS duration, (count(*) * 90000 // gcd(count(*) * 90000, sum(l_suppkey + 1)::BIGINT)) || '/' || (sum(l_suppkey + 1)::BIGINT // gcd(count(*) * 90000, sum(l_suppkey + 1)::BIGINT)) AS rate FROM lineitem GROUP BY l_orderkey")
def average_frame_rates(spark, sf_dir):
    """Average frame rate of every track."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.count("*").alias("samples"), F.sum(F.col("l_suppkey") + 1).alias("duration"))
    return rows.withColumn("rate", P.average_frame_rate(F.col("samples"), F.col("duration"), F.lit(90000).cast("bigint")))
