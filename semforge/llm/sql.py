"""DuckDB SQL for the queries that SQL can express. The others rest on XXH64, a codec, a model or an edit distance."""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: DuckDB has no function for it."""
    steps = f"list_concat([4294967295::BIGINT], flatten([[ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN string_split({text}, '')]))"
    return f"xor(list_reduce({steps}, lambda a, e: CASE WHEN e < 0 THEN xor(a >> 1, (a & 1) * 3988292384) ELSE xor(a, e) END), 4294967295::BIGINT)"


_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS size FROM d),
w AS (SELECT doc_id, unnest(range(0, size - 49)) AS i, h FROM n WHERE size >= 50),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM w),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k HAVING min(doc_id) < max(doc_id)),
s AS (SELECT k.doc_id, k.i FROM k JOIN f USING (k) WHERE f.first < k.doc_id),
runs AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
keep AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, size) - a)), '' ORDER BY a) AS h FROM keep JOIN n USING (doc_id) GROUP BY doc_id),
r AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS c FROM spans GROUP BY doc_id)
SELECT n.doc_id, n.size::BIGINT AS n_bytes, coalesce(r.removed, 0)::BIGINT AS n_removed, coalesce(r.c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM w),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM k JOIN f USING (k) WHERE f.first < k.doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS c FROM words ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.c, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to FROM m
"""

_OP12 = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) % 20 AS d FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE d <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role[1]) OVER w AS before FROM m
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
w AS (SELECT conv_id, n AS pos, {'c': 0, 's': ''} AS w0, {'c': 6, 's': 'II'} AS w1, {'c': 3, 's': 'I'} AS w2, {'c': 0, 's': ''} AS w3 FROM g
  UNION ALL SELECT conv_id, pos, w0, w1, w2, w3 FROM (
    SELECT conv_id, pos, least(e0, {'c': 3 + o2.c, 's': 'I' || o2.s}) AS w0, least(e1, {'c': 3 + o2.c, 's': 'I' || o2.s}) AS w1, least(e2, {'c': 3 + o3.c, 's': 'I' || o3.s}) AS w2, least(e3, {'c': 3 + o2.c, 's': 'I' || o2.s}) AS w3 FROM (
      SELECT *, least(e2, {'c': 3 + e3.c, 's': 'I' || e3.s}) AS o2, least(e3, {'c': 3 + e2.c, 's': 'I' || e2.s}) AS o3 FROM (
        SELECT w.conv_id, w.pos - 1 AS pos,
          least({'c': 4 + w0.c, 's': 'D' || w0.s}, {'c': keep + w1.c + CASE WHEN role[1] = 's' THEN 0 ELSE 1000000000 END, 's': 'K' || w1.s}, {'c': keep + w2.c + CASE WHEN role[1] = 'u' THEN 0 ELSE 1000000000 END, 's': 'K' || w2.s}, {'c': 3 + keep + w2.c, 's': 'R' || w2.s}) AS e0,
          least({'c': 4 + w1.c, 's': 'D' || w1.s}, {'c': keep + w2.c + CASE WHEN role[1] = 'u' THEN 0 ELSE 1000000000 END, 's': 'K' || w2.s}, {'c': 3 + keep + w2.c, 's': 'R' || w2.s}) AS e1,
          least({'c': 4 + w2.c, 's': 'D' || w2.s}, {'c': keep + w3.c + CASE WHEN role[1] = 'a' THEN 0 ELSE 1000000000 END, 's': 'K' || w3.s}, {'c': 3 + keep + w3.c, 's': 'R' || w3.s}) AS e2,
          least({'c': 4 + w3.c, 's': 'D' || w3.s}, {'c': keep + w2.c + CASE WHEN role[1] = 'u' THEN 0 ELSE 1000000000 END, 's': 'K' || w2.s}, {'c': 3 + keep + w2.c, 's': 'R' || w2.s}) AS e3
        FROM w JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 3 WHEN '' THEN 0 ELSE 1000000000 END AS keep FROM f) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos)))),
a AS (SELECT conv_id, w0.c AS cost, w0.s AS audit FROM w WHERE pos = 0),
r AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS rows FROM f GROUP BY conv_id),
t AS (SELECT a.conv_id, audit, rows, 1::BIGINT AS k, 1::BIGINT AS p, 0 AS q, []::VARCHAR[] AS lines FROM a JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id
  UNION ALL SELECT conv_id, audit, rows, k + 1, p + CASE WHEN audit[k] = 'I' THEN 0 ELSE 1 END,
    CASE WHEN audit[k] = 'D' THEN q WHEN q = 0 AND audit[k] = 'K' AND rows[p].role[1] = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
    CASE audit[k] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, rows[p].role || ':' || rows[p].text) ELSE list_append(lines, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN audit[k] = 'R' THEN rows[p].text ELSE '' END) END
  FROM t WHERE k <= length(audit)),
s AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS h FROM t WHERE k = length(audit) + 1)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
""".replace("CRC(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))", _crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))

_OP13 = """
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'k': sha256(length(role)::VARCHAR || ':' || role || text), 'n': length(text)} ORDER BY pos) AS turns FROM c GROUP BY conv_id),
b AS (SELECT l.conv_id, list_concat(coalesce(p.turns[1:h], []), l.turns[h+1:]) AS turns FROM (SELECT *, CRC(conv_id::VARCHAR) % 6 AS h FROM l) l LEFT JOIN l p ON p.conv_id = l.conv_id - l.conv_id % 100),
s AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM b),
x AS (SELECT conv_id, size, depth, array_to_string([t.k FOR t IN turns[1:depth]], ',') AS node, CASE WHEN depth = 0 THEN '' ELSE array_to_string([t.k FOR t IN turns[1:depth-1]], ',') END AS above, CASE WHEN depth = 0 THEN 0 ELSE turns[depth].n END AS n FROM s),
v AS (SELECT node, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth)), sha256('')) AS ends_sha256 FROM x GROUP BY node, depth),
k AS (SELECT above AS node, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY above),
y AS (SELECT v.*, coalesce(k.n_children, 0) AS n_children FROM v LEFT JOIN k USING (node)),
u AS (SELECT x.node, sum(y.saved) AS saved_tokens, count(*) FILTER (y.n_children = 0) AS n_leaves FROM (SELECT DISTINCT x.node, y.node AS low FROM x JOIN (SELECT conv_id, depth, node FROM v) y ON x.conv_id = y.conv_id AND x.depth <= y.depth) x JOIN y ON y.node = x.low GROUP BY x.node)
SELECT y.conv_id, y.depth::BIGINT AS depth, CASE WHEN y.depth > 0 THEN p.conv_id END AS parent_conv_id, y.n_convs::BIGINT AS n_convs, y.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, y.ends_sha256
FROM y JOIN u USING (node) LEFT JOIN v p ON y.above = p.node AND p.depth = y.depth - 1
""".replace("CRC(conv_id::VARCHAR)", _crc32("conv_id::VARCHAR"))

ORACLES: dict[str, str] = {"op1_suffix_dedup": _OP1, "op3_substring_dedup": _OP3, "op4_warc": _OP4, "op12_conversation_repair": _OP12, "op13_prefix_trie": _OP13}
