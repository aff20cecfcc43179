"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS.format(c="text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
phrases AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[k + 1 : k + least(10, len(w))], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(0, greatest(1, len(w) - 9))) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_BENCH_WORDS.format(c="text")} AS w FROM documents),
places AS (SELECT doc_id, size, k, array_to_string(w[k + 1 : k + size], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS k FROM docs, (SELECT DISTINCT size FROM phrases) WHERE len(w) >= size)),
found AS (SELECT doc_id, k, size, item FROM places JOIN phrases USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS spot FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

WARC = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
first AS (SELECT digest, min(page_id) AS first_page FROM own WHERE octet_length(encode(html)) >= 100 GROUP BY digest)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first_page IS NULL OR first_page = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM own LEFT JOIN first USING (digest)
"""

TOP_K = """
WITH own AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM own q JOIN own x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

CHAT = r"""
WITH own AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) + 24 AS n FROM own)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

MIXING = r"""
WITH RECURSIVE own AS (SELECT doc_id, source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))) AS BIGINT) AS n_tokens FROM documents GROUP BY ALL),
shares AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t, ln(sum(n_tokens) / sum(sum(n_tokens)) OVER ()) AS q FROM own GROUP BY source HAVING sum(n_tokens) > 0),
range_of AS (SELECT max(q) AS most, min(q) AS least, count(*) AS n FROM shares),
even AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
  SELECT step + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT e.*, (SELECT ln(sum(exp((q - most) * (lo + hi) / 2))) - sum(exp((q - most) * (lo + hi) / 2) * (q - most) * (lo + hi) / 2) / sum(exp((q - most) * (lo + hi) / 2)) FROM shares, range_of)
    >= 0.98 * (SELECT ln(n) FROM range_of) AS ok FROM even e WHERE step < 40)),
few AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT f.*, (1 - (lo + hi) / 2) * (SELECT most - least FROM range_of) <= ln(4) AS ok FROM few f WHERE step < 40)),
chosen AS (SELECT round(greatest(CASE WHEN (SELECT -sum(exp(q) * q) >= 0.98 * ln(any_value(n)) FROM shares, range_of) THEN 1 ELSE (SELECT lo FROM even WHERE step = 40) END,
  CASE WHEN (SELECT most - least <= ln(4) FROM range_of) THEN 0 ELSE (SELECT hi FROM few WHERE step = 40) END), 9) AS exponent),
weighted AS (SELECT source, t, exp((q - most) * exponent) / sum(exp((q - most) * exponent)) OVER () AS p FROM shares, range_of, chosen),
planned AS (SELECT source, t, CAST(round(max(t / p) OVER () * p) AS BIGINT) AS budget FROM weighted
  UNION ALL SELECT source, 0, 0 FROM own GROUP BY source HAVING sum(n_tokens) = 0),
cut AS (SELECT *, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS whole, CASE WHEN t > 0 THEN budget - budget // t * t ELSE 0 END AS rest,
  CAST(ceil(greatest(t, 1) / 1048576.0) AS BIGINT) AS blocks FROM planned),
passes AS (SELECT *, CAST('0x' || md5('mix:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:8] AS BIGINT) AS h
  FROM (SELECT o.*, c.* EXCLUDE source, unnest(range(0, whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM own o JOIN cut c ON o.source IS NOT DISTINCT FROM c.source)),
placed AS (SELECT *, (h * blocks) >> 32 AS block, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS done FROM passes)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, block, n_tokens, CASE WHEN budget > 0 THEN round(CAST(epoch * t + done - n_tokens AS DOUBLE) / budget, 9) ELSE 0 END AS place
FROM placed WHERE epoch < whole OR done <= rest
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format(c="text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS k FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y USING (g) JOIN sizes n ON n.doc_id = x.doc_id JOIN sizes m ON m.doc_id = y.doc_id
  WHERE x.doc_id <> y.doc_id AND 100 * least(n.n, m.n) >= 80 * greatest(n.n, m.n) GROUP BY x.doc_id, y.doc_id, n.n, m.n HAVING 100 * count(*) >= 80 * (n.n + m.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM docs UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
