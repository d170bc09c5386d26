"""DuckDB SQL that gives the rows of those queries that SQL can express.

Tokenizers (1, 2), a trained model (3), XXH64 fingerprints (4), union-find over suffix
classes (12) and eigenvectors (13) are beyond it.
"""

from __future__ import annotations

from . import line_dedup, multiset_hash, outliers

WORD_PATTERN = r"[^ \t-\r]+"
SPACE_PATTERN = r"[ \t-\r]+"


def mixing_sql(share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 20) -> str:
    kinds = f"[{', '.join(map(str, map(float, weights)))}]"
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, {kinds}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}]::DOUBLE AS weight FROM s
), f AS (
  SELECT *, coalesce(sum(source_size) OVER before, 0)::DOUBLE AS full_size, coalesce(sum(weight) OVER before, 0) AS full_weight,
    (sum(source_size) OVER ())::DOUBLE AS all_size, sum(weight) OVER () AS all_weight
  FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, ({share}::DOUBLE * all_size - {most}::DOUBLE * full_size) / (all_weight - full_weight) AS level FROM f
), t AS (
  SELECT source, source_size, least({most}::DOUBLE * source_size, coalesce((SELECT level FROM l WHERE level * weight <= {most}::DOUBLE * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1), 'inf'::DOUBLE) * weight) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected FROM t
), p AS (
  SELECT source, source_size, target, floor(expected)::BIGINT AS sure, expected - floor(expected) AS p, target - floor(expected) * source_size AS open FROM e
), u AS (
  SELECT d.doc_id, d.size, p.*, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), z AS (
  SELECT *, (u * (1 - p)) / ((1 - u) * p) AS z FROM u WHERE p > 0 AND size > 0
), r AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY z / (1 + z), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2 <= open AS drawn FROM z
)
SELECT u.doc_id, u.size, u.source_size, u.target, ((u.sure + coalesce(r.drawn, false)::BIGINT) * u.size)::BIGINT AS taken
FROM u LEFT JOIN r ON u.doc_id IS NOT DISTINCT FROM r.doc_id
"""


DEDUP_SQL = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n, sha256(regexp_replace(coalesce(text, ''), '{SPACE_PATTERN}', '', 'g')) AS text_sha256 FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id != first THEN first END AS refers_to
FROM w
"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


LINES_SQL = f"""
WITH t AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{_quoted(line_dedup.HOST)}', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_quoted(line_dedup.HIDDEN)}', '', 'g'), '{_quoted(line_dedup.BREAKS)}', chr(10), 'g'), '{_quoted(line_dedup.TAG)}', '', 'g') AS text
  FROM pages
), l AS (
  SELECT page_id, host, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g')), lambda s: s != '') AS lines FROM t
), h AS (
  SELECT host, count(*) AS pages FROM l WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= 5
), e AS (
  SELECT host, unnest(list_distinct(lines)) AS line FROM l
), b AS (
  SELECT e.host, list(line) AS dropped FROM (SELECT host, line, count(*) AS n FROM e GROUP BY host, line) e JOIN h ON e.host = h.host WHERE n > 0.3::DOUBLE * pages GROUP BY e.host
), k AS (
  SELECT page_id, l.host, lines, CASE WHEN dropped IS NULL THEN lines ELSE list_filter(lines, lambda s: NOT list_contains(dropped, s)) END AS kept FROM l LEFT JOIN b ON l.host = b.host
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, md5(array_to_string(kept, chr(10))) AS text_md5 FROM k
"""

PREFERENCE_SQL = """
WITH c AS (
  SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT pair_id, max(turn) AS last_turn, arg_max(text, (turn, text)) AS reply FROM c WHERE role = 'assistant' GROUP BY pair_id
), rest AS (
  SELECT c.* FROM c LEFT JOIN r USING (pair_id) WHERE last_turn IS NULL OR turn IS NULL OR turn < last_turn
  UNION ALL
  SELECT r.pair_id, r.last_turn, 'assistant', o.reply FROM r JOIN r o ON o.pair_id = xor(r.pair_id, 1)
), b AS (
  SELECT 'chosen' AS side, * FROM c UNION ALL SELECT 'rejected', * FROM rest
), n AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, same) - 1 AS position FROM (SELECT *, md5(length(role) || ':' || role || text) AS same FROM b)
), x AS (
  SELECT pair_id, position, count(*) < 2 OR min(same) != max(same) AS differs FROM n GROUP BY pair_id, position
), p AS (
  SELECT pair_id, coalesce(min(CASE WHEN differs THEN position END), max(position) + 1) AS prefix FROM x GROUP BY pair_id
), t AS (
  SELECT n.*, CASE WHEN position < prefix THEN 'prompt' ELSE side END AS part, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM n JOIN p USING (pair_id) WHERE side = 'chosen' OR position >= prefix
), s AS (
  SELECT *, length(head || body) AS n, coalesce(sum(length(head || body)) OVER (PARTITION BY pair_id, part ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t
), l AS (
  SELECT *, CASE WHEN part != 'prompt' AND role = 'assistant' THEN start + length(head) ELSE start + n END AS loss_start, start + n AS loss_end FROM s
), m AS (
  SELECT *, ('0x' || substr(md5(position || ':' || md5(head || body)), 1, 15))::BIGINT AS what, ('0x' || substr(md5(loss_start || ':' || loss_end), 1, 15))::BIGINT AS mask FROM l
)
SELECT pair_id,
  count(*) FILTER (part = 'prompt') AS prompt_turns,
  coalesce(sum(n) FILTER (part = 'prompt'), 0)::BIGINT AS prompt_chars,
  coalesce(bit_xor(what) FILTER (part = 'prompt'), 0) AS prompt_digest,
  count(*) FILTER (part = 'chosen') AS chosen_turns,
  coalesce(sum(n) FILTER (part = 'chosen'), 0)::BIGINT AS chosen_chars,
  coalesce(bit_xor(what) FILTER (part = 'chosen'), 0) AS chosen_digest,
  count(*) FILTER (part = 'chosen' AND loss_end > loss_start) AS chosen_spans,
  coalesce(sum(loss_end - loss_start) FILTER (part = 'chosen'), 0)::BIGINT AS chosen_loss_chars,
  coalesce(bit_xor(mask) FILTER (part = 'chosen' AND loss_end > loss_start), 0) AS chosen_mask,
  count(*) FILTER (part = 'rejected') AS rejected_turns,
  coalesce(sum(n) FILTER (part = 'rejected'), 0)::BIGINT AS rejected_chars,
  coalesce(bit_xor(what) FILTER (part = 'rejected'), 0) AS rejected_digest,
  count(*) FILTER (part = 'rejected' AND loss_end > loss_start) AS rejected_spans,
  coalesce(sum(loss_end - loss_start) FILTER (part = 'rejected'), 0)::BIGINT AS rejected_loss_chars,
  coalesce(bit_xor(mask) FILTER (part = 'rejected' AND loss_end > loss_start), 0) AS rejected_mask
FROM m GROUP BY pair_id
"""


def outliers_sql(cutoff: float = outliers.CUTOFF, steps: int = outliers.LEAST_STEPS) -> str:
    """The base counts, and the estimates with one block of common table expressions per concentration step; more than these are taken where a determinant still falls after them."""
    names, floors = outliers.NAMES, [f * f for f in outliers.FLOORS.values()]
    p = range(len(names))
    pairs = [(i, j) for i in p for j in range(i + 1)]

    def factored(source: str, to: str) -> str:
        """From m_i, c_ij to m_i, l_ij, one expression level per column of the triangle."""
        parts, last = [], source
        for k, (i, j) in enumerate(pairs):
            c = f"c_{i}{j}" + (f" + {floors[i]!r}::DOUBLE" if i == j else "")
            c = " - ".join([f"({c})", *(f"l_{i}{m} * l_{j}{m}" for m in range(j))])
            value = f"sqrt({c})" if i == j else f"({c}) / l_{j}{j}"
            parts.append(f"{to}_{k} AS (SELECT *, {value} AS l_{i}{j} FROM {last})")
            last = f"{to}_{k}"
        columns = ", ".join(["grp", "start", *(f"m_{i}" for i in p), *(f"l_{i}{j}" for i, j in pairs), "2 * (" + " + ".join(f"ln(l_{i}{i})" for i in p) + ") AS log_det"])
        return ", ".join([*parts, f"{to} AS MATERIALIZED (SELECT {columns} FROM {last})"])

    def distance(source: str, to: str) -> str:
        parts, last = [], source
        for i in p:
            parts.append(f"{to}_y{i} AS (SELECT *, (" + " - ".join([f"{names[i]} - m_{i}", *(f"l_{i}{k} * y_{k}" for k in range(i))]) + f") / l_{i}{i} AS y_{i} FROM {last})")
            last = f"{to}_y{i}"
        return ", ".join([*parts, f"{to} AS (SELECT *, {' + '.join(f'y_{i} * y_{i}' for i in p)} AS d FROM {last})"])

    def moments(source: str, to: str, widen: float) -> str:
        sums = ", ".join([*(f"sum({names[i]}) AS s_{i}" for i in p), *(f"sum({names[i]} * {names[j]}) AS q_{i}{j}" for i, j in pairs)])
        values = ", ".join([*(f"s_{i} / n AS m_{i}" for i in p), *(f"{widen!r}::DOUBLE * ((q_{i}{j} - s_{i} * s_{j} / n) / n) AS c_{i}{j}" for i, j in pairs)])
        return f"{to}_s AS (SELECT grp, start, count(*)::DOUBLE AS n, {sums} FROM {source} GROUP BY grp, start), {to} AS (SELECT grp, start, {values} FROM {to}_s)"

    vectors = ", ".join(names)
    sql = f"""
WITH t AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS MATERIALIZED (
  SELECT *, regexp_extract_all(text, '{WORD_PATTERN}') AS words, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^ \\t-\\r]')) AS lines FROM t
), g AS (
  SELECT id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), again AS (
  SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS k FROM again) GROUP BY id
), base AS (
  SELECT w.id, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.id = covered.id
), b AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN ln(word_chars / n_words::DOUBLE) END AS x_word, CASE WHEN n_words > 0 THEN ln(1 + 10.0::DOUBLE * n_symbols / n_words::DOUBLE) END AS x_symbol,
    CASE WHEN n_words > 0 THEN ln(1 + 100.0::DOUBLE * n_dup_lines / n_words::DOUBLE) END AS x_lines, CASE WHEN n_words > 0 THEN ln(1 + 10.0::DOUBLE * n_repeat_words / n_words::DOUBLE) END AS x_repeat
  FROM base
), z AS (
  SELECT lang, source, count(*) AS n FROM b WHERE NOT base_failed GROUP BY lang, source
), y AS (
  SELECT lang, source, CASE WHEN n >= {outliers.LEAST_ROWS} THEN 2 WHEN sum(n) OVER (PARTITION BY lang) >= {outliers.LEAST_ROWS} THEN 1 ELSE 0 END AS level FROM z
), gr AS MATERIALIZED (
  SELECT lang, source, level, [level::VARCHAR, CASE WHEN level > 0 THEN lang END, CASE WHEN level > 1 THEN source END]::VARCHAR || CASE WHEN lang IS NULL AND level > 0 THEN '-' ELSE '' END || CASE WHEN source IS NULL AND level > 1 THEN '-' ELSE '' END AS grp FROM y
), v AS MATERIALIZED (
  SELECT k.grp, (word_chars * 31 + n_words) % {outliers.PARTS} AS part, {vectors} FROM (SELECT DISTINCT grp, level, CASE WHEN level > 0 THEN lang END AS lang, CASE WHEN level > 1 THEN source END AS source FROM gr) k
  JOIN b ON NOT b.base_failed AND (k.level < 1 OR b.lang IS NOT DISTINCT FROM k.lang) AND (k.level < 2 OR b.source IS NOT DISTINCT FROM k.source)
), q AS (
  SELECT grp, k, quantile_disc(x, 0.25) AS a, quantile_disc(x, 0.5) AS m, quantile_disc(x, 0.75) AS c
  FROM (SELECT grp, unnest({list(p)}) AS k, floor(unnest([{vectors}]) * 1000 + 0.5)::BIGINT AS x FROM v) GROUP BY grp, k
), s AS (
  SELECT grp, 0 AS start, {', '.join(f'max(CASE WHEN k = {i} THEN m / 1000.0::DOUBLE END) AS m_{i}' for i in p)},
    {', '.join((f'max(CASE WHEN k = {i} THEN (c / 1000.0::DOUBLE - a / 1000.0::DOUBLE) / 1.349::DOUBLE END) ** 2' if i == j else '0::DOUBLE') + f' AS c_{i}{j}' for i, j in pairs)}
  FROM q GROUP BY grp
), o AS (
  SELECT grp, 1 AS start, {vectors} FROM v UNION ALL SELECT grp, 2, {vectors} FROM v WHERE part = 0 UNION ALL SELECT grp, 3, {vectors} FROM v WHERE part = {outliers.PARTS // 2}
), {moments('o', 'mo', 1.0)}, s0 AS (
  SELECT * FROM s UNION ALL BY NAME SELECT * FROM mo
), {factored('s0', 'fit0')}"""
    for k in range(1, steps + 1):
        sql += f""", j{k} AS (
  SELECT v.*, f.* EXCLUDE (grp) FROM v JOIN fit{k - 1} f ON v.grp = f.grp
), {distance(f'j{k}', f'd{k}')}, r{k} AS MATERIALIZED (
  SELECT grp, start, {vectors}, floor(ln(1e-9::DOUBLE + d) * {outliers.PER_LOG})::BIGINT AS r FROM d{k}
), h{k} AS (
  SELECT grp, start, quantile_disc(r, 0.5) AS at FROM r{k} GROUP BY grp, start
), n{k} AS (
  SELECT r.* FROM r{k} r JOIN h{k} h ON r.grp = h.grp AND r.start = h.start WHERE r.r <= h.at
), {moments(f'n{k}', f'm{k}', outliers.CONSISTENCY)}, {factored(f'm{k}', f'fit{k}')}"""
    return (
        sql
        + f""", best AS (
  SELECT * FROM fit{steps} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(log_det, 6), start) = 1
), judged AS (
  SELECT b.*, f.* EXCLUDE (grp) FROM b LEFT JOIN gr ON b.lang IS NOT DISTINCT FROM gr.lang AND b.source IS NOT DISTINCT FROM gr.source LEFT JOIN best f ON gr.grp = f.grp
), {distance('judged', 'final')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d <= {cutoff}, true) AS kept FROM final
"""
    )


def multiset_sql() -> str:
    """Lanes as sums over unnested pieces; a word of the fingerprint is three lanes of 20 bits, 21 apart."""
    bits, hashes, lanes = multiset_hash.BITS, multiset_hash.PER_HASH, range(3)
    step, modulus = bits + 1, 1 << bits
    words = ", ".join(f"('0x' || sha[{1 + multiset_hash.DIGITS * k} : {multiset_hash.DIGITS * (k + 1)}])::BIGINT AS w{k}" for k in range(hashes))
    lane = lambda k, j, b: f"sum((w{k} >> {j + bits * b}) & 1) % {modulus}"
    digest = lambda k, b: f"sum((w{k} >> {bits * b}) & {modulus - 1}) % {modulus}"
    digests = ", ".join(f"[{', '.join(digest(k, b) for b in lanes)}]::BIGINT[] AS d{k}" for k in range(hashes))
    signs = ", ".join(f"[{', '.join(lane(k, j, b) for b in lanes)}]::BIGINT[] AS s{k}_{j}" for k in range(hashes) for j in range(bits))
    none = ", ".join(f"coalesce(s{k}_{j}, [0, 0, 0])" for k in range(hashes) for j in range(bits))
    centred = lambda v: f"((({v}) % {modulus} + {3 * modulus // 2}) % {modulus} - {modulus // 2})"
    square = lambda a, m: f"list_sum(list_transform({a}, lambda v: (2 * {centred('v')} - {centred(m)}) * (2 * {centred('v')} - {centred(m)})))"
    apart = lambda a, b: square(f"list_transform(list_zip({a}.l, {b}.l), lambda z: z[1] - z[2])", f"{a}.n - {b}.n")
    near = lambda a, b: f"CASE WHEN {a}.fp = {b}.fp THEN 1 WHEN {a}.sq + {b}.sq = 0 THEN 0 ELSE greatest(0::DOUBLE, 1::DOUBLE - ({apart(a, b)})::DOUBLE / ({a}.sq + {b}.sq)::DOUBLE) END"
    return f"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, sha256(coalesce(text, ''))) AS k, count(*) OVER () AS rows, doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT d.*, f.k AS next, left(d.text, d.n - d.n // 2) || left(f.text, d.n // 2) AS edited FROM d JOIN d f ON f.k = d.k % d.rows + 1
), t AS (
  SELECT k, 0 AS kind, text FROM e UNION ALL SELECT k, 1, edited FROM e
), p AS (
  SELECT k, kind, {words} FROM (SELECT k, kind, sha256(unnest(string_split(text, chr(10)))) AS sha FROM t)
), s AS (
  SELECT k, kind, {words} FROM (SELECT k, kind, sha256(unnest(list_filter(string_split_regex(text, '{multiset_hash.SENTENCE_END}'), lambda s: s != ''))) AS sha FROM t)
), ps AS (
  SELECT k, kind, {digests} FROM p GROUP BY k, kind
), ss AS (
  SELECT k, kind, (count(*) % {modulus})::BIGINT AS n, {signs} FROM s GROUP BY k, kind
), v AS (
  SELECT ps.k, ps.kind, [{', '.join(f'd{k}' for k in range(hashes))}] AS d, [{none}] AS s, coalesce(n, 0) AS n FROM ps LEFT JOIN ss ON ps.k = ss.k AND ps.kind = ss.kind
), x AS MATERIALIZED (
  SELECT k, kind, n, flatten(s) AS l, array_to_string(list_transform(d || s || [[n, 0, 0]], lambda w: printf('%016x', w[1] + (w[2] << {step}) + (w[3] << {2 * step}))), '') AS fp, {square('flatten(s)', 'n')} AS sq FROM v
)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, {near('a', 'b')} AS near_edited, {near('a', 'c')} AS near_next
FROM e JOIN x a ON a.k = e.k AND a.kind = 0 JOIN x b ON b.k = e.k AND b.kind = 1 JOIN x c ON c.k = e.next AND c.kind = 0
"""


ORACLES: dict[str, str] = {
    "op5_line_dedup": LINES_SQL,
    "op6_mixing": mixing_sql(),
    "op7_stream_dedup": DEDUP_SQL,
    "op8_preference": PREFERENCE_SQL,
    "op9_zip_warc": WARC_SQL,
    "op10_outliers": outliers_sql(),
    "op11_multiset_hash": multiset_sql(),
}
