"""Common table expressions that mirror the adapters in DuckDB SQL."""

EVENT_PACKETS = """
k AS (
  SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS stream_index FROM (SELECT DISTINCT event_type FROM events)
), p AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS packet_index, stream_index, e.event_type,
    epoch_us(ts) AS pts, epoch_us(ts) AS dts, floor(value * 1000 + 0.5)::BIGINT AS duration, octet_length(encode(coalesce(props, '')))::BIGINT AS size,
    CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END AS flags, encode(coalesce(props, '')) AS payload
  FROM events e JOIN k ON e.event_type = k.event_type
)"""

TURN_PACKETS = """
p AS (
  SELECT conv_id AS file_id, turn::BIGINT AS packet_index, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END::BIGINT AS stream_index,
    turn::BIGINT AS pts, turn::BIGINT AS dts, 1::BIGINT AS duration, octet_length(encode(coalesce(text, '')))::BIGINT AS size, coalesce(text, '') AS text
  FROM conversations
)"""

FILES = """
f AS (
  SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang AS path, encode(coalesce(text, '')) AS content, octet_length(encode(coalesce(text, '')))::BIGINT AS length FROM documents
)"""

RUNS = """
r AS (
  SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord,
    l_quantity::BIGINT AS count, (l_suppkey + 1)::BIGINT AS delta, (l_partkey % 5)::BIGINT AS offs, (l_partkey + 1)::BIGINT AS size FROM lineitem
), b AS (
  SELECT *, coalesce(sum(count) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM r WHERE count > 0
), s AS (
  SELECT file_id, unnest(range(base, base + count)) AS sample, delta, offs, size FROM b
)"""


def pcm(packet_bytes: int) -> str:
    return f"""
c AS (
  SELECT file_id, content, length, unnest(range(0, (length + {packet_bytes - 1}) // {packet_bytes})) AS packet_index FROM f
), q AS (
  SELECT file_id, packet_index, least({packet_bytes}, length - packet_index * {packet_bytes})::BIGINT AS size, content[packet_index * {packet_bytes} + 1 : packet_index * {packet_bytes} + {packet_bytes}] AS payload FROM c
)"""


def rounded(n: str, d: str, mode: str) -> str:
    """HUGEINT n / d in one of the five roundings."""
    n, d = f"({n})", f"({d})"
    q, r = f"({n} // {d})", f"({n} % {d})"  # towards zero
    up, down = f"(CASE WHEN {r} > 0 THEN 1 ELSE 0 END)", f"(CASE WHEN {r} < 0 THEN 1 ELSE 0 END)"
    step = {"zero": "0", "inf": f"{up} - {down}", "down": f"-{down}", "up": up, "near": f"(CASE WHEN abs({r}) * 2 >= {d} THEN {up} - {down} ELSE 0 END)"}[mode]
    return f"({q} + {step})::BIGINT"


def micros_text(value: str, num: str, den: str) -> str:
    m = rounded(f"abs({value})::HUGEINT * {num} * 1000000", den, "near")
    return f"(CASE WHEN {value} < 0 THEN '-' ELSE '' END || ({m} // 1000000)::VARCHAR || '.' || lpad(({m} % 1000000)::VARCHAR, 6, '0'))"


#: CRC-32 of hexadecimal text: the table of all bytes by its rule, then a fold over the bytes.
CRC_TABLE = "ct AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"


def crc32_of_hex(h: str) -> str:
    """The CRC-32 of the bytes in ``h``, with ``ct.t`` at hand."""
    values = f"list_transform(range(1, length({h}) // 2 + 1), lambda i: ('0x' || {h}[2 * i - 1 : 2 * i])::BIGINT)"
    return f"lower(printf('%08x', xor(4294967295, list_reduce([4294967295::BIGINT] || {values}, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])))))"
