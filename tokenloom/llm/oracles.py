"""DuckDB SQL for operators that SQL can say by brute force: all windows, all pairs, the merge loop."""

from __future__ import annotations

from tokenloom.llm import embeddings, suffix_dedup
from tokenloom.plans.oracles import encoding

_L = suffix_dedup.LENGTH
#: Every window of every document, in hex digits; the runs of bytes that windows seen in a smaller doc_id cover, and what is left.
OP1_SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, k, substr(h, 2 * k + 1, {2 * _L}) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {_L - 1})) AS k FROM t)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM w JOIN f USING (s) WHERE least < doc_id),
run AS (SELECT doc_id, k, sum(CASE WHEN before >= k - {_L} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM hit),
spans AS (SELECT doc_id, r, min(k) AS a, max(k) + {_L} AS b FROM run GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM spans),
g AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""

_COMPONENTS = """reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""
#: Sets of two-word shingles; all pairs that share one.
OP2_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM t),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
link AS MATERIALIZED (SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id AND 5 * p.n >= 4 * q.n AND 5 * q.n >= 4 * p.n
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
{_COMPONENTS}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept FROM s LEFT JOIN least ON doc_id = a
"""

#: All pairs of vectors that can be compared.
OP9_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
fit AS MATERIALIZED (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
link AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM fit p JOIN fit q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= {embeddings.THRESHOLD}),
{_COMPONENTS}, n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, CAST(least(vec_id, coalesce(b, vec_id)) AS BIGINT) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM v LEFT JOIN least ON vec_id = least.a LEFT JOIN n ON vec_id = n.a
"""

_SEGMENTS = "(SELECT {doc: doc_id, ix: ix} AS doc_id, text FROM (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS ix FROM (SELECT doc_id, string_split(coalesce(text, ''), '<|endoftext|>') AS s FROM documents)))"
#: The merge loop on each piece, the special token's id between the segments; ids as little-endian hex digits.
OP7_SQL = f"""
WITH RECURSIVE {encoding(_SEGMENTS)},
m AS (SELECT doc_id.doc AS doc_id, flatten(list(CASE WHEN doc_id.ix > 1 THEN [50256::BIGINT] || ids ELSE ids END ORDER BY doc_id.ix)) AS ids FROM coded GROUP BY doc_id.doc),
h AS (SELECT doc_id, string_agg(array_to_string(hexes, ''), '' ORDER BY ix) AS h FROM cut JOIN known USING (piece) GROUP BY doc_id),
d AS (SELECT s.doc_id.doc AS doc_id, string_agg(CASE WHEN s.doc_id.ix > 1 THEN hex(encode('<|endoftext|>')) ELSE '' END || coalesce(h, ''), '' ORDER BY s.doc_id.ix) AS h FROM src s LEFT JOIN h USING (doc_id) GROUP BY s.doc_id.doc),
x AS (SELECT doc_id, ids, list_transform(ids, lambda i: format('{{:08x}}', i)) AS big FROM m)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens,
  sha256(unhex(array_to_string(list_transform(big, lambda b: b[7:8] || b[5:6] || b[3:4] || b[1:2]), ''))) AS ids_sha256, sha256(unhex(h)) AS decoded_sha256
FROM x JOIN d USING (doc_id)
"""
