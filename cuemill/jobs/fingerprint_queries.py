"""Queries over payload digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests
from ..operators import fingerprint as FP
from ..operators import packets as P
from ..sources import adapters, media
from .fragments import CRC_TABLE, EVENT_PACKETS, FILES, TURN_PACKETS, crc32_of_hex, pcm
from .packet_queries import event_packets
from .registry import query, table


def turn_packets(spark, sf_dir):
    return adapters.packets_from_conversations(table(spark, sf_dir, "conversations"))


_BYTES = """
x AS (SELECT *, hex(payload) AS h, octet_length(payload) AS n FROM p),
y AS (SELECT *, list_transform(range(1, n + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT) AS bytes FROM x),
z AS (SELECT *, coalesce(list_sum(bytes), 0)::BIGINT % 65521 AS a, coalesce(list_sum(list_transform(bytes, lambda v, i: v * (n - i + 1))), 0)::BIGINT % 65521 AS b FROM y)"""


@query(f"WITH {EVENT_PACKETS}, {_BYTES} SELECT file_id, packet_index, size, '0x' || lower(printf('%08x', b * 65536 + a)) AS checksum FROM z")
def framecrc(spark, sf_dir):
    """Packet checksums that start from 0."""
    return FP.framecrc(event_packets(spark, sf_dir)).select("file_id", "packet_index", "size", "checksum")


@query(
    f"WITH {EVENT_PACKETS}, {_BYTES} SELECT file_id, packet_index, stream_index || ', ' || lpad(dts::VARCHAR, greatest(10, length(dts::VARCHAR))::INT, ' ') || ', ' || lpad(pts::VARCHAR, greatest(10, length(pts::VARCHAR))::INT, ' ') || ', ' || lpad(duration::VARCHAR, greatest(8, length(duration::VARCHAR))::INT, ' ') || ', ' || lpad(size::VARCHAR, 8, ' ') || ', 0x' || lower(printf('%08x', b * 65536 + a)) AS line FROM z"
)
def framecrc_lines(spark, sf_dir):
    """Checksum lists as text rows."""
    return FP.framecrc_lines(FP.framecrc(event_packets(spark, sf_dir)))


@query(f"WITH {TURN_PACKETS} SELECT file_id, packet_index, stream_index || ', ' || lpad(dts::VARCHAR, 10, ' ') || ', ' || lpad(pts::VARCHAR, 10, ' ') || ', ' || lpad(duration::VARCHAR, 8, ' ') || ', ' || lpad(size::VARCHAR, 8, ' ') || ', ' || sha256(text) AS line FROM p")
def framehash_lines(spark, sf_dir):
    """SHA-256 of every packet as text rows."""
    return FP.framehash_lines(FP.framehash(turn_packets(spark, sf_dir), "sha256"))


@query(f"WITH {TURN_PACKETS} SELECT file_id, stream_index, sha256(string_agg(text, '' ORDER BY packet_index)) AS digest, count(*) AS packets, sum(size)::BIGINT AS bytes FROM p GROUP BY file_id, stream_index")
def streamhash(spark, sf_dir):
    """SHA-256 of every stream's payloads in order."""
    return FP.streamhash(turn_packets(spark, sf_dir), "sha256")


@query(f"WITH {TURN_PACKETS} SELECT file_id, stream_index, stream_index || ',' || CASE stream_index WHEN 0 THEN 'd' WHEN 1 THEN 'a' ELSE 'v' END || ',MD5=' || md5(string_agg(text, '' ORDER BY packet_index)) AS line FROM p GROUP BY file_id, stream_index")
def streamhash_lines(spark, sf_dir):
    """Stream digests as text rows with stream types."""
    kind = F.when(F.col("stream_index") == 0, "data").when(F.col("stream_index") == 1, "audio").otherwise("video")
    return FP.streamhash_lines(FP.streamhash(turn_packets(spark, sf_dir), "md5").withColumn("codec_type", kind), "md5")


@query(f"WITH {TURN_PACKETS} SELECT file_id, sha256(string_agg(text, '' ORDER BY packet_index)) AS digest, count(*) AS packets, sum(size)::BIGINT AS bytes FROM p GROUP BY file_id")
def filehash(spark, sf_dir):
    """SHA-256 of every file's payloads in order."""
    return FP.filehash(turn_packets(spark, sf_dir))


@query(f"WITH {TURN_PACKETS} SELECT file_id, 'MD5=' || md5(string_agg(text, '' ORDER BY packet_index)) AS line FROM p GROUP BY file_id")
def filehash_lines(spark, sf_dir):
    """File digests as text rows."""
    return FP.hash_lines(FP.filehash(turn_packets(spark, sf_dir), "md5"), "md5")


@query(
    f"WITH {EVENT_PACKETS}, w AS (SELECT file_id, stream_index, string_agg(coalesce(decode(payload), ''), '' ORDER BY packet_index) AS text FROM p GROUP BY file_id, stream_index), q AS (SELECT *, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM w), v AS (SELECT *, list_transform(range(1, n + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT) AS bytes FROM q), s AS (SELECT file_id, stream_index, (1 + coalesce(list_sum(bytes), 0)::BIGINT) % 65521 AS a, (n + coalesce(list_sum(list_transform(bytes, lambda v, i: v * (n - i + 1))), 0)::BIGINT) % 65521 AS b FROM v) SELECT file_id, stream_index, lower(printf('%08x', b * 65536 + a)) AS digest FROM s"
)
def adler32_of_streams(spark, sf_dir):
    """Adler-32 of streams from per-packet parts; payloads don't travel."""
    a, b = FP.adler_parts(F.col("payload"))
    parts = event_packets(spark, sf_dir).select("file_id", "stream_index", "packet_index", "size", a.alias("a"), b.alias("b"))
    return FP.adler32_merge(parts, ["file_id", "stream_index"])


@query(f"WITH {TURN_PACKETS}, {CRC_TABLE}, w AS (SELECT file_id, stream_index, hex(encode(string_agg(text, '' ORDER BY packet_index))) AS h FROM p GROUP BY file_id, stream_index) SELECT file_id, stream_index, {crc32_of_hex('h')} AS digest FROM w, ct")
def crc32_of_streams(spark, sf_dir):
    """CRC-32 of streams from per-packet parts; payloads don't travel."""
    parts = turn_packets(spark, sf_dir).select("file_id", "stream_index", "packet_index", "size", F.crc32("payload").alias("crc"))
    return FP.crc32_merge(parts, ["file_id", "stream_index"])


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha160, sha256(coalesce(text, '')) AS sha256, to_base64(unhex(md5(coalesce(text, '')))) AS md5_base64, sha256(coalesce(text, ''))[1:16] AS sha256_cut, 'MD5:' || md5(coalesce(text, '')) AS labelled FROM documents")
def digests_of_files(spark, sf_dir):
    """Built-in digests, base64, truncation and labels."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    md5, sha = digests.hash_hex(data, "md5"), digests.hash_hex(data, "SHA-256")
    return table(spark, sf_dir, "documents").select("doc_id", md5.alias("md5"), digests.hash_hex(data, "sha1").alias("sha160"), sha.alias("sha256"), digests.digest_base64(md5).alias("md5_base64"), digests.truncated(sha, 8).alias("sha256_cut"), digests.labelled(md5, "md5").alias("labelled"))


@query()
def other_digests_of_files(spark, sf_dir):
    """The digests that Spark lacks, over whole pages (tested against vectors)."""
    data = F.coalesce("html", F.lit("")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", *[digests.hash_hex(data, n).alias(n.lower().replace("/", "_")) for n in digests.ALGORITHMS])


@query("SELECT md5(coalesce(text, '')) AS digest, count(*) AS copies, min(source || '/' || doc_id) AS first_path FROM documents GROUP BY 1")
def duplicate_payloads(spark, sf_dir):
    """Distinct payloads with their copies."""
    rows = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return P.dedup_by_digest(rows)


_PERTURBED = "e AS (SELECT file_id, stream_index, packet_index, md5(text) AS digest FROM p WHERE packet_index != 3), a AS (SELECT file_id, stream_index, packet_index, md5(CASE WHEN file_id % 7 = 0 AND packet_index = 1 THEN text || '!' ELSE text END) AS digest FROM p WHERE NOT (file_id % 5 = 0 AND packet_index = 0))"


def _two_lists(spark, sf_dir):
    p = turn_packets(spark, sf_dir)
    keys = ["file_id", "stream_index", "packet_index"]
    changed = F.when((F.col("file_id") % 7 == 0) & (F.col("packet_index") == 1), F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))
    expected = p.where("packet_index != 3").select(*keys, F.md5("payload").alias("digest"))
    actual = p.where("not (file_id % 5 = 0 and packet_index = 0)").select(*keys, F.md5(changed).alias("digest"))
    return expected, actual


@query(f"WITH {TURN_PACKETS}, {_PERTURBED} SELECT file_id, stream_index, packet_index, e.digest AS expected, a.digest AS actual, CASE WHEN a.digest IS NULL THEN 'missing' WHEN e.digest IS NULL THEN 'extra' WHEN e.digest = a.digest THEN 'same' ELSE 'different' END AS status FROM e FULL JOIN a USING (file_id, stream_index, packet_index)")
def compared_fingerprints(spark, sf_dir):
    """Two checksum lists row by row."""
    return FP.compare(*_two_lists(spark, sf_dir))


@query(f"WITH {TURN_PACKETS}, {_PERTURBED} SELECT 'expected' AS side, * FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'actual', * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e) UNION ALL SELECT 'both', * FROM (SELECT * FROM e INTERSECT SELECT * FROM a)")
def fingerprint_sets(spark, sf_dir):
    """What is on one side only, and on both."""
    e, a = _two_lists(spark, sf_dir)
    part = lambda side, df: df.select(F.lit(side).alias("side"), *e.columns)
    return part("expected", FP.only_in(e, a)).unionByName(part("actual", FP.only_in(a, e))).unionByName(part("both", FP.in_both(e, a)))


@query(f"WITH {TURN_PACKETS}, {FILES}, {pcm(512)} SELECT kind, count(*) AS packets, sum(size)::BIGINT AS bytes, min(digest) AS least_digest FROM (SELECT 'turns' AS kind, size, md5(text) AS digest FROM p UNION ALL SELECT 'pcm', size, md5(payload) FROM q) GROUP BY kind")
def united_packets(spark, sf_dir):
    """Packets of several sources in one model."""
    turns = turn_packets(spark, sf_dir).withColumn("kind", F.lit("turns"))
    audio = media.packetize_pcm(adapters.files_from_documents(table(spark, sf_dir, "documents")), 1, 256).withColumn("kind", F.lit("pcm"))
    both = media.union_packets(turns, audio).select("kind", "size", F.md5("payload").alias("digest"))
    return both.groupBy("kind").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"), F.min("digest").alias("least_digest"))


@query(f"WITH {EVENT_PACKETS} SELECT file_id, count(DISTINCT event_type) AS types FROM (SELECT file_id, packet_index % 2 AS s, event_type FROM p) GROUP BY file_id, s HAVING count(DISTINCT event_type) > 1")
def stream_type_conflicts(spark, sf_dir):
    """Streams whose packets have several types (streams here mix event types on purpose)."""
    rows = event_packets(spark, sf_dir).withColumn("stream_index", F.col("packet_index") % 2).withColumnRenamed("event_type", "codec_type")
    return FP.type_conflicts(rows).select("file_id", "types")
