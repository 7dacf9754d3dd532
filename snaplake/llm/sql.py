"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

#: Runs of exact containment over word shingles, as in decontaminate.contained_items.
_OP2 = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents WHERE text IS NOT NULL
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM benchmark WHERE text IS NOT NULL
), item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[i:i + 4], ' ') AS s
  FROM item_words, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id
), doc_shingles AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT * FROM doc_words, (SELECT DISTINCT n FROM item_shingles) WHERE len(w) >= n), unnest(range(1, len(w) - n + 2)) AS t(i)
), shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (s, n) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""

_OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id
), roots AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.id = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""

#: Rows of vectors that take part, with integer components.
_WHOLE = """v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

_OP11 = f"""
WITH {_WHOLE}, scored AS (
  SELECT a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id AS id, list_inner_product(a.e, o.e)::BIGINT AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND o.label IS NOT NULL
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

_OP12 = f"""
WITH {_WHOLE}
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, o.e) DESC, o.vec_id)::INT AS rank, o.vec_id, list_inner_product(q.e, o.e)::BIGINT AS score
FROM v q JOIN v o ON q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
"""

_OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT lang, source, d, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT lang, s.source, term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
  FROM kept k JOIN langs l USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
)
SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(f, 0)::BIGINT AS value, row_number() OVER (PARTITION BY g.lang, g.source ORDER BY coalesce(f, 0) DESC, o.source)::INT AS rank
FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
UNION ALL
SELECT lang, source, 'term', term, (p - q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INT AS rank
FROM shares WHERE n > 0 AND p > q QUALIFY rank <= 50
"""

ORACLES = {"op2_decontamination": _OP2, "op3_embedding_links": _OP3, "op11_hard_negatives": _OP11, "op12_top_k": _OP12, "op13_source_divergence": _OP13}
