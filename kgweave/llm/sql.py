"""The same results in SQL, for queries SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["p1_found"] = """
WITH a AS (SELECT DISTINCT disease_id, assoc_id, score, evidence_count FROM disease_associations WHERE score IS NOT NULL AND NOT isnan(score) AND disease_id IS NOT NULL),
h AS (SELECT DISTINCT source_id, hypothesis_id, score FROM hypotheses WHERE score IS NOT NULL AND NOT isnan(score) AND source_id IS NOT NULL)
SELECT 'disease_associations' AS src, disease_id AS group_key, assoc_id AS item_id FROM a
QUALIFY row_number() OVER (PARTITION BY disease_id ORDER BY score DESC, evidence_count DESC NULLS LAST, assoc_id) <= 5
UNION ALL
SELECT 'hypotheses', source_id, hypothesis_id FROM h
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, hypothesis_id) <= 3
"""

SQL["p3_found"] = """
SELECT DISTINCT 'pubmed_articles' AS src, article_id AS item_id FROM pubmed_articles WHERE length(abstract) > 1500
UNION ALL
SELECT DISTINCT 'documents', doc_id FROM documents WHERE length(text) > 1500
"""

_VALUES = """
WITH n AS (SELECT DISTINCT record_id, id, name, properties, sources, updated_at FROM kg_nodes WHERE id IS NOT NULL),
multi AS (SELECT id FROM n GROUP BY id HAVING count(DISTINCT record_id) > 1),
r AS (SELECT n.*, (SELECT min(trust_rank) FROM source_trust t WHERE list_contains(n.sources, t.source)) AS trust FROM n JOIN multi USING (id)),
f AS (SELECT id, record_id, trust, updated_at, 'name' AS field, name AS value FROM r
      UNION ALL SELECT id, record_id, trust, updated_at, 'properties.' || e.key, e.value FROM (SELECT id, record_id, trust, updated_at, unnest(map_entries(properties)) AS e FROM r)),
best AS (SELECT id, field, record_id, value FROM f
      WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('', '-', '--', '?', 'n/a', 'na', 'none', 'null', 'unknown', 'tbd', 'missing', 'not available')
      QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY coalesce(trust, 2147483647), updated_at DESC NULLS LAST, record_id) = 1)
"""

SQL["p6_found"] = _VALUES + "SELECT id, field, record_id FROM best"
SQL["p6_survivors"] = (
    _VALUES
    + """, s AS (SELECT id, string_agg(s, '|' ORDER BY s) AS sources FROM (SELECT DISTINCT id, unnest(sources) AS s FROM r) WHERE s IS NOT NULL GROUP BY id),
p AS (SELECT id, string_agg(substr(field, 12) || '=' || value, '|' ORDER BY substr(field, 12) || '=' || value) AS properties FROM best WHERE field <> 'name' GROUP BY id)
SELECT multi.id, b.value AS name, coalesce(p.properties, '') AS properties, coalesce(s.sources, '') AS sources
FROM multi LEFT JOIN best b ON b.id = multi.id AND b.field = 'name' LEFT JOIN p ON p.id = multi.id LEFT JOIN s ON s.id = multi.id
"""
)

SQL["p6_undated"] = """
WITH RECURSIVE n AS (SELECT DISTINCT record_id, id, name, properties, sources, CASE WHEN record_id % 3 <> 0 THEN updated_at END AS seen_at FROM kg_nodes WHERE id IS NOT NULL),
multi AS (SELECT id FROM n GROUP BY id HAVING count(DISTINCT record_id) > 1),
r AS (SELECT n.*, (SELECT min(trust_rank) FROM source_trust t WHERE list_contains(n.sources, t.source)) AS trust FROM n JOIN multi USING (id)),
f AS (SELECT id, record_id, trust, seen_at, 'name' AS field, name AS value FROM r
      UNION ALL SELECT id, record_id, trust, seen_at, 'properties.' || e.key, e.value FROM (SELECT id, record_id, trust, seen_at, unnest(map_entries(properties)) AS e FROM r)),
seen AS MATERIALIZED (SELECT id, field, value, min({'rank': coalesce(trust, 2147483647), 'late': coalesce(-epoch_us(seen_at), 9223372036854775807), 'record': record_id}) AS first, max(seen_at) AS seen_at, bool_or(seen_at IS NULL) AS undated
      FROM f WHERE value IS NOT NULL AND lower(trim(value)) NOT IN ('', '-', '--', '?', 'n/a', 'na', 'none', 'null', 'unknown', 'tbd', 'missing', 'not available') GROUP BY ALL),
steps AS (SELECT field, lag(value) OVER (PARTITION BY id, field ORDER BY seen_at, value) AS earlier, value AS later FROM seen WHERE seen_at IS NOT NULL),
counts AS (SELECT field, earlier, later, count(*) AS n FROM steps WHERE earlier IS NOT NULL GROUP BY ALL),
prec AS MATERIALIZED (SELECT a.field, a.earlier, a.later FROM counts a LEFT JOIN counts b ON b.field = a.field AND b.earlier = a.later AND b.later = a.earlier WHERE a.n > coalesce(b.n, 0)),
leaders AS (SELECT id, field, min(first.rank) AS least, bool_or(undated) AS undated FROM seen GROUP BY ALL),
opened AS MATERIALIZED (SELECT s.* FROM seen s JOIN leaders l USING (id, field) WHERE l.undated AND s.first.rank = l.least),
values_open AS MATERIALIZED (SELECT DISTINCT field, value FROM opened),
reach AS (SELECT p.field, p.earlier AS start, p.later AS value FROM prec p JOIN values_open v ON v.field = p.field AND v.value = p.earlier
      UNION SELECT reach.field, reach.start, p.later FROM reach JOIN prec p ON p.field = reach.field AND p.earlier = reach.value),
after AS MATERIALIZED (SELECT a.field, a.start, a.value FROM reach a WHERE NOT EXISTS (SELECT 1 FROM reach b WHERE b.field = a.field AND b.start = a.value AND b.value = a.start)),
passed AS (SELECT DISTINCT o.id, o.field, o.value FROM opened o JOIN after a ON a.field = o.field AND a.start = o.value JOIN opened q ON q.id = o.id AND q.field = o.field AND q.value = a.value),
ranked AS (SELECT s.id, s.field, s.value, s.first, p.id IS NOT NULL AS passed FROM seen s LEFT JOIN passed p ON p.id = s.id AND p.field = s.field AND p.value = s.value)
SELECT id, field, first.record AS record_id, value FROM ranked QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY first.rank, passed, first.late, first.record, value) = 1
"""
