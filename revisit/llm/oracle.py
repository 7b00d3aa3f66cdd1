"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_sql(text: str, k: int, percent: int, columns: str) -> str:
    """Components of documents whose k-word shingle sets are alike to ``percent``."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({text}, '{WORD}') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
sizes AS (SELECT doc_id, count(s.shingle) AS n FROM words LEFT JOIN shingles s USING (doc_id) GROUP BY doc_id),
sized AS (SELECT doc_id, n, hash(shingle) AS bucket, shingle FROM shingles JOIN sizes USING (doc_id)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS both_have
  FROM sized a JOIN sized b ON a.bucket = b.bucket AND a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n GROUP BY ALL),
links AS (SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM common WHERE 100 * both_have >= {percent} * (n + m - both_have)),
reach AS (SELECT doc_id, doc_id AS to_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.to_id),
component AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, {columns} FROM sizes JOIN component USING (doc_id)
"""


NEAR_DEDUP = near_sql(LOWER, 3, 85, "n AS n_shingles, component_id, doc_id = component_id AS kept")
NEAR_GROUPS = near_sql("coalesce(text, '')", 5, 80, "component_id AS near_id")

SUBSTRING_DEDUP = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 49], ' ') AS passage
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM words)),
first_in AS (SELECT passage, min(doc_id) AS least FROM windows GROUP BY passage),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM windows JOIN first_in USING (passage) WHERE least < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
cut AS (SELECT p.doc_id, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN p.word END, ' ' ORDER BY p.pos) AS kept
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""

HARD_NEGATIVES = """
WITH vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored
  WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER list::INTEGER AS rank, s.vec_id AS negative_id,
  p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW list AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER list <= 5
"""

SOURCE_AUDIT = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWER}, '[a-z\x{{80}}-\x{{10FFFF}}]+') AS found FROM documents),
words AS (SELECT id, lang, source, unnest(found) AS term FROM docs),
per_doc AS (SELECT id, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
lang_terms AS (SELECT lang, term, sum(n) AS n FROM per_doc GROUP BY ALL HAVING count(*) >= 10),
lang_sums AS (SELECT lang, sum(n) AS total, count(*) AS v FROM lang_terms GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
group_terms AS (SELECT lang, source, term, sum(n) AS n FROM per_doc SEMI JOIN lang_terms USING (lang, term) GROUP BY ALL),
group_sums AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN group_terms USING (lang, source) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT) // (s.total + 2 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (t.n + 2)::HUGEINT) // (l.total + 2 * l.v)::HUGEINT AS q
  FROM groups g JOIN lang_sums l USING (lang) JOIN group_sums s USING (lang, source) JOIN lang_terms t USING (lang)
  LEFT JOIN group_terms c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM all_pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": NEAR_DEDUP, "op6_similar_documents": NEAR_GROUPS, "op10_substring_dedup": SUBSTRING_DEDUP,
            "op12_hard_negatives": HARD_NEGATIVES, "op13_source_audit": SOURCE_AUDIT}
