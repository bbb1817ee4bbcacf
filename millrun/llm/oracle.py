"""DuckDB SQL of the numbered operators, where SQL can express them."""

ORACLE: dict[str, str] = {}

ORACLE["op1_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last
  FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM g
"""

ORACLE["op5_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Words of a text, as a list.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE["op6_decontaminate"] = f"""
WITH b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), starts AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (
  SELECT s.doc_id, s.i, s.n, bw.item_id FROM starts s JOIN bw ON s.n = bw.n AND s.g = bw.g
), words_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op2_suffix_dedup"] = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS g
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM t)
), m AS (
  SELECT g, min(doc_id) AS first_id FROM s GROUP BY g HAVING min(doc_id) <> max(doc_id)
), c AS (
  SELECT s.doc_id, s.i FROM s JOIN m ON s.g = m.g AND m.first_id < s.doc_id
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
        FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new
              FROM c))
  GROUP BY doc_id, k
), kept AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), joined AS (
  SELECT k.doc_id, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a)
           || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS rest,
         sum(b - a) AS n_removed, count(*) AS n_spans
  FROM kept k JOIN t ON k.doc_id = t.doc_id GROUP BY k.doc_id
)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM t LEFT JOIN joined j ON t.doc_id = j.doc_id
"""

def _escaped(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\b'), '<', '\\l')"


ORACLE["op10_chat"] = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, row_number() OVER w AS seq, tokens, sum(tokens) OVER w - tokens AS before,
         length(replace({_escaped('role')}, '>', '\g')) + length({_escaped('text')}) + 15 AS chars
  FROM (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\s]')) AS tokens FROM given)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT conv_id, min(seq) AS s_seq, arg_min(tokens, seq) AS s_tokens, arg_min(chars, seq) AS s_chars
  FROM t WHERE role = 'system' GROUP BY conv_id
), g AS (
  SELECT *, before // cell AS g, 2 * (before // cell) + CASE WHEN tokens > cell THEN 1 ELSE 0 END AS win
  FROM (SELECT t.*, s_seq, s_chars, 1024 - coalesce(s_tokens, 0) AS room,
               greatest(512, 1024 - coalesce(s_tokens, 0)) // 2 AS cell
        FROM t LEFT JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id)
), w AS (
  SELECT conv_id, win, min(before) AS since, any_value(s_seq) AS s_seq, any_value(s_chars) AS s_chars,
         least(256, greatest(0, any_value(room) - sum(tokens))) AS reach, bool_or(seq = s_seq) AS has_system
  FROM g GROUP BY conv_id, win
), h AS (
  SELECT w.conv_id, sum(g.chars) AS chars
  FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.win < w.win AND g.before < w.since
    AND g.before >= w.since - w.reach AND g.seq IS DISTINCT FROM g.s_seq
  GROUP BY w.conv_id
), r AS (
  SELECT conv_id, sum(s_chars) AS chars FROM w WHERE s_seq IS NOT NULL AND NOT has_system GROUP BY conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '') AS learned, sum(chars) AS chars
  FROM t GROUP BY conv_id
)
SELECT d.conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256,
       CAST(d.chars + coalesce(h.chars, 0) + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars
FROM d LEFT JOIN h ON d.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN r ON d.conv_id IS NOT DISTINCT FROM r.conv_id
"""

#: CRC-32 of a number's decimal text: a byte is taken in, then eight steps (marked -1) follow.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1),
           lambda i: [CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"""

ORACLE["op13_prefix_trie"] = rf"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, n, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY c)
), r AS (
  SELECT k.c, o.seq AS pos, role, text FROM k JOIN o ON o.c = k.base AND o.seq <= k.h
  UNION ALL
  SELECT k.c, o.seq - k.h + least(k.h, coalesce(b.n, 0)) AS pos, role, text
  FROM k JOIN o ON o.c = k.c AND o.seq > k.h LEFT JOIN k b ON b.c = k.base
), p AS (
  SELECT c, 0 AS depth, sha256('') AS f, NULL AS parent, 0 AS words FROM k
  UNION ALL
  SELECT c, pos AS depth, sha256(string_agg(t, '' ORDER BY pos) OVER w) AS f,
         sha256(coalesce(string_agg(t, '' ORDER BY pos) OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS parent,
         words
  FROM (SELECT c, pos, sha256(length(role) || ':' || role || text) AS t,
               len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM r)
  WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)
), size AS (
  SELECT c, max(depth) AS size FROM p GROUP BY c
), node AS (
  SELECT depth, f, min(p.c) AS c, count(*) AS n_convs, any_value(parent) AS parent, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (size = depth), '')) AS ends_sha256
  FROM p JOIN size USING (c) GROUP BY depth, f
), kids AS (
  SELECT depth - 1 AS depth, parent AS f, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), own AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, f)
), total AS (
  SELECT p.depth, p.f, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * own.words) AS saved
  FROM own JOIN p ON p.c = own.c AND p.depth <= own.depth GROUP BY p.depth, p.f
)
SELECT own.c AS conv_id, CAST(own.depth AS BIGINT) AS depth, up.c AS parent_conv_id, CAST(own.n_convs AS BIGINT) AS n_convs,
       CAST(own.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       own.ends_sha256, CAST(own.words AS BIGINT) AS words
FROM own JOIN total USING (depth, f) LEFT JOIN node up ON up.depth = own.depth - 1 AND up.f = own.parent
"""

ORACLE["op11_substring_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM t)
), m AS (
  SELECT g, min(doc_id) AS first_id FROM s GROUP BY g HAVING min(doc_id) <> max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM s JOIN m ON s.g = m.g AND m.first_id < s.doc_id
), words AS (
  SELECT t.doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM t) t
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS rest, count(*) AS n_kept
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
