"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from plotshift.llm.quality import RULES, _cased_stop_words

LIMIT = {r.name: r for r in RULES}
WORD = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z only.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in _cased_stop_words())
    high = {k: LIMIT[k].high for k in ("word_length", "symbols", "repeated_lines", "shouting")}
    return rf"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM documents),
    r AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n
      FROM (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, array_to_string(ws[i:i + 4], ' ') AS run FROM w WHERE len(ws) >= 5)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
    m AS (
      SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(regexp_extract_all(body, '[!#*$%&<>{{}}\[\]=~^]'))::BIGINT AS n_marks,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop, len(ls) AS n_lines
      FROM w LEFT JOIN c USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS k FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR word_chars / k < {LIMIT["word_length"].low} OR word_chars / k > {high["word_length"]}
                OR n_symbols / k > {high["symbols"]} OR n_marks / k > {high["shouting"]}
                OR (n_stop + 1) / (n_words + 1) < {LIMIT["stop_words"].low}
                OR n_dup_lines / greatest(n_lines, 1) > {high["repeated_lines"]}) AS kept
    FROM b"""


NEAR = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS x
          FROM w WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * hits >= 80 * (na.n + nb.n - hits)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
    FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

REPEATS = rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
    g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS least
          FROM (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, md5(array_to_string(ws[i:i + 49], ' ')) AS run FROM w WHERE len(ws) >= 50)),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g WHERE least < doc_id),
    t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w WHERE len(ws) > 0),
    k AS (SELECT doc_id, count(c.p) AS gone, string_agg(t.x, ' ' ORDER BY p) FILTER (WHERE c.p IS NULL) AS kept
          FROM t LEFT JOIN c USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN k USING (doc_id)"""

LEAKS = rf"""
    WITH b AS (SELECT item_id, regexp_extract_all({LOWER}, '{PLAIN}') AS ws FROM benchmark),
    v AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS run
          FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
    w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{PLAIN}') AS ws FROM documents),
    h AS (SELECT doc_id, i, v.n, v.item_id
          FROM (SELECT doc_id, z.n, unnest(range(1, len(ws) - z.n + 2)) AS i, array_to_string(ws[i:i + z.n - 1], ' ') AS run
                FROM w, (SELECT DISTINCT n FROM v) z WHERE len(ws) >= z.n) d JOIN v ON v.n = d.n AND v.run = d.run),
    p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: Unsigned CRC-32 of an ASCII string, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda z: ascii(z)::BIGINT)),
    lambda a, z: list_reduce([xor(a, z), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, n: xor(b >> 1, 3988292384 * (b & 1)))))"""

TRIE = f"""
    WITH o AS (
      SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
      FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT DISTINCT conv_id, {CRC.format(x="conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS donor FROM o),
    b AS (SELECT c.conv_id, p, r, x FROM c JOIN o ON o.conv_id = c.donor AND p <= h
          UNION ALL SELECT c.conv_id, p, r, x FROM c JOIN o ON o.conv_id = c.conv_id AND p > h),
    q AS (SELECT c.conv_id, coalesce(list({{'r': r, 'x': x}} ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS seq FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
    m AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS d, seq FROM q),
    k AS (SELECT conv_id, d, n = d AS ends, min(conv_id) OVER (PARTITION BY d, md5(seq[1:d]::VARCHAR), seq[1:d]) AS node,
                 CASE WHEN d > 0 THEN strlen(seq[d].x) ELSE 0 END AS bytes FROM m),
    v AS (SELECT node, d, count(*) AS n_convs, any_value(bytes) AS bytes, min(CASE WHEN d > 0 THEN up END) AS parent,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
          FROM (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM k) GROUP BY node, d),
    g AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM v WHERE parent IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT DISTINCT a.node, a.d, z.node AS below, z.d AS e FROM k a JOIN k z ON a.conv_id = z.conv_id AND z.d >= a.d),
    s AS (SELECT t.node, t.d, count(*) FILTER (WHERE g.n IS NULL) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved
          FROM t JOIN v w ON w.node = t.below AND w.d = t.e LEFT JOIN g ON g.node = t.below AND g.d = t.e GROUP BY t.node, t.d)
    SELECT v.node AS conv_id, v.d AS depth, v.parent AS parent_conv_id, v.n_convs, coalesce(g.n, 0)::BIGINT AS n_children,
           s.n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
    FROM v JOIN s ON s.node = v.node AND s.d = v.d LEFT JOIN g ON g.node = v.node AND g.d = v.d"""

SQL = {
    "op4_bottom_k_near_dedup": NEAR,
    "op6_quality_rules": _quality(),
    "op8_positional_index": LEAKS,
    "op10_block_anchors": REPEATS,
    "op13_burst_trie": TRIE,
}
