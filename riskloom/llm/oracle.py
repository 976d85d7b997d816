"""The queries that SQL can express over whole tables, for checking results.

Learned models, schedules and token merges are beyond SQL; tests/llm compares those with brute
force.
"""

from __future__ import annotations

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
      FROM scored)
WHERE place <= 5
"""

EMBEDDINGS = """
WITH RECURSIVE d AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
      AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
u AS (
    SELECT vec_id, label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS unit FROM d),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
      ON a.label = b.label AND a.vec_id <> b.vec_id
     AND list_dot_product(a.unit, b.unit) >= CAST(0.93 AS DOUBLE)),
reached(id, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT id, b FROM reached JOIN links ON a = other),
components AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN components ON id = e.vec_id LEFT JOIN counts ON a = e.vec_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
    FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
single AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM single x JOIN single y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id),
links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reached(id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT id, b FROM reached JOIN links ON a = other),
components AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN components ON id = doc_id
"""

REPEATS = """
WITH docs AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
           octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, greatest(n_bytes - 99, 0))) AS p FROM docs),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM places),
later AS (
    SELECT doc_id, p FROM strings
    QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
opened AS (
    SELECT doc_id, p, CAST(p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS INTEGER)
        AS opens FROM later),
numbered AS (
    SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM opened),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, k),
gaps AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
cut AS (
    SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
           string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
    FROM gaps g JOIN docs USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""

EQUAL_TEXTS = """
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
met AS (
    SELECT *, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size FROM texts
    WINDOW same AS (PARTITION BY t))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
       sha256(t) AS text_sha256
FROM met
"""

ORACLE_SQL = {
    "op1_exact_topk": TOP_K,
    "op2_embedding_dedup": EMBEDDINGS,
    "op5_near_dedup": NEAR_DUPLICATES,
    "op6_suffix_dedup": REPEATS,
    "op13_exact_dedup": EQUAL_TEXTS,
}
