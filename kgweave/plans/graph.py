"""Queries over the graph: store, lookups, relational queries and analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import graph as G
from ..operators import learning as L
from ..operators.runtime import table
from ..schema import EDGE_BETWEEN, edge_type_between
from .testbed import DELIVERY, GRAPH, HAY, graph, node_records, slim_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOPIC = "syndrome"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


def _text(c):
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


def _props(c):
    return F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), "|"), F.lit(""))


def _tenth(spark: SparkSession, d: str, node_type: str) -> DataFrame:
    """Query nodes: every node of a type whose delivered record number is divisible by 50."""
    return node_records(spark, d).filter((F.col("record_id") % 50 == 0) & (F.col("node_type") == node_type)).select("id").distinct()


def _tenth_sql(node_type: str) -> str:
    return f"(SELECT DISTINCT id FROM kg_nodes WHERE record_id % 50 = 0 AND node_type = '{node_type}')"


def _paths_sql(levels: int = 6) -> str:
    """SQL of paths (source, target, length, path) between {pairs}: frontiers that keep the first path to each node."""
    out = """near_ AS MATERIALIZED (SELECT source_id AS id, target_id AS other FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id),
p0 AS MATERIALIZED (SELECT DISTINCT source, target, source AS id, [source] AS path FROM {pairs}), s0 AS MATERIALIZED (SELECT source, target, id FROM p0)"""
    for k in range(1, levels + 1):
        out += f""", p{k} AS MATERIALIZED (SELECT p.source, p.target, n.other AS id, min(list_append(p.path, n.other)) AS path FROM p{k - 1} p JOIN near_ n USING (id) WHERE p.id <> p.target
  AND NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.source = p.source AND s.target = p.target AND s.id = n.other) AND NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.source = p.source AND s.target = p.target AND s.id = p.target) GROUP BY ALL),
s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT source, target, id FROM p{k})"""
    found = " UNION ALL ".join([f"SELECT source, target, {k} AS length, path FROM p{k} WHERE id = target" + (" AND id IN (SELECT id FROM nodes)" if k == 0 else "") for k in range(levels + 1)])
    return out + f", paths AS MATERIALIZED ({found}) "


PATHS = _paths_sql()


# --- store -----------------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT * FROM kg_nodes WHERE id IS NOT NULL)
SELECT k.id, a.name, b.node_type, c.year FROM (SELECT DISTINCT id FROM r) k
LEFT JOIN (SELECT id, name FROM r WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, record_id DESC) = 1) a ON a.id = k.id
LEFT JOIN (SELECT id, node_type FROM r WHERE node_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, record_id DESC) = 1) b ON b.id = k.id
LEFT JOIN (SELECT id, year FROM r WHERE year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, record_id DESC) = 1) c ON c.id = k.id
""")
def i01_add_node(spark, d):
    rows = node_records(spark, d).select("id", "name", "node_type", "year", *DELIVERY)
    return G.put_nodes(rows, F.struct(*DELIVERY)).select("id", "name", "node_type", "year")


@query("""
WITH r AS (SELECT DISTINCT id, name, properties, sources, updated_at, record_id FROM kg_nodes WHERE id IS NOT NULL),
n AS (SELECT id, name FROM r WHERE name IS NOT NULL AND name <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, record_id DESC) = 1),
e AS (SELECT id, updated_at, record_id, unnest(map_entries(properties)) AS e FROM r),
p AS (SELECT id, e.key AS k, e.value AS v FROM e QUALIFY row_number() OVER (PARTITION BY id, e.key ORDER BY updated_at DESC, record_id DESC) = 1),
pp AS (SELECT id, string_agg(k || '=' || coalesce(v, 'null'), '|' ORDER BY k || '=' || coalesce(v, 'null')) AS properties FROM p GROUP BY id),
s AS (SELECT id, string_agg(s, '|' ORDER BY s) AS sources FROM (SELECT DISTINCT id, unnest(sources) AS s FROM r) WHERE s IS NOT NULL GROUP BY id)
SELECT k.id, n.name, coalesce(pp.properties, '') AS properties, coalesce(s.sources, '') AS sources
FROM (SELECT DISTINCT id FROM r) k LEFT JOIN n ON n.id = k.id LEFT JOIN pp ON pp.id = k.id LEFT JOIN s ON s.id = k.id
""")
def i02_merge_node(spark, d):
    rows = node_records(spark, d).select("id", "name", "properties", "sources", *DELIVERY)
    m = G.merge_nodes(rows, F.struct(*DELIVERY))
    return m.select("id", "name", _props(F.col("properties")).alias("properties"), _text(F.col("sources")).alias("sources"))


@query("""
SELECT source_id, target_id, edge_type, edge_id, score FROM (
  SELECT DISTINCT source_id, target_id, coalesce(lower(edge_type), 'gene_interacts_with_gene') AS edge_type, edge_id, coalesce(score, 1.0) AS score, loaded_at
  FROM kg_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY source_id, target_id, edge_type ORDER BY loaded_at DESC, edge_id DESC) = 1
""")
def i03_add_edge(spark, d):
    rows = G.clean_edges(table(spark, d, "kg_edges")).select(*G.EDGE_KEY, "edge_id", "score", "loaded_at")
    return G.put_edges(rows, F.struct("loaded_at", "edge_id")).drop("loaded_at")


@query("""
WITH r AS (SELECT DISTINCT source_id, target_id, coalesce(lower(edge_type), 'gene_interacts_with_gene') AS edge_type, coalesce(score, 1.0) AS score, sources, properties, loaded_at, edge_id
  FROM kg_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
b AS (SELECT source_id, target_id, edge_type, max(score) AS score FROM r GROUP BY ALL),
s AS (SELECT source_id, target_id, edge_type, string_agg(s, '|' ORDER BY s) AS sources FROM (SELECT DISTINCT source_id, target_id, edge_type, unnest(sources) AS s FROM r) WHERE s IS NOT NULL GROUP BY ALL),
e AS (SELECT source_id, target_id, edge_type, loaded_at, edge_id, unnest(map_entries(properties)) AS e FROM r),
p AS (SELECT source_id, target_id, edge_type, e.key AS k, e.value AS v FROM e QUALIFY row_number() OVER (PARTITION BY source_id, target_id, edge_type, e.key ORDER BY loaded_at DESC, edge_id DESC) = 1),
pp AS (SELECT source_id, target_id, edge_type, string_agg(k || '=' || coalesce(v, 'null'), '|' ORDER BY k || '=' || coalesce(v, 'null')) AS properties FROM p GROUP BY ALL)
SELECT source_id, target_id, edge_type, score, coalesce(sources, '') AS sources, coalesce(properties, '') AS properties
FROM b LEFT JOIN s USING (source_id, target_id, edge_type) LEFT JOIN pp USING (source_id, target_id, edge_type)
""")
def i04_merge_edge(spark, d):
    e = graph(spark, d).edges
    return e.select(*G.EDGE_KEY, "score", _text(F.col("sources")).alias("sources"), _props(F.col("properties")).alias("properties"))


@query(GRAPH + """, n AS (SELECT id, node_type, row_number() OVER (PARTITION BY node_type ORDER BY id) - 1 AS i FROM nodes WHERE node_type IS NOT NULL)
SELECT s.node_type AS source_type, e.edge_type, t.node_type AS target_type, count(*) AS n, CAST(sum(s.i) AS BIGINT) AS source_sum, CAST(sum(t.i) AS BIGINT) AS target_sum
FROM edges e JOIN n s ON s.id = e.source_id JOIN n t ON t.id = e.target_id GROUP BY ALL
""")
def i19_typed_edge_index(spark, d):
    """Local index of each node within its type, and edges bucketed by (source type, relation, target type)."""
    kg = slim_graph(spark, d)
    n = G.local_index(kg.nodes)
    e = kg.edges.join(n.select(F.col("id").alias("source_id"), F.col("node_type").alias("source_type"), F.col("i").alias("si")), "source_id")
    e = e.join(n.select(F.col("id").alias("target_id"), F.col("node_type").alias("target_type"), F.col("i").alias("ti")), "target_id")
    return e.groupBy("source_type", "edge_type", "target_type").agg(F.count(F.lit(1)).alias("n"), F.sum("si").alias("source_sum"), F.sum("ti").alias("target_sum"))


# --- lookups ---------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT edge_id, source_id, target_id, score FROM kg_edges WHERE edge_type = 'drug_targets_gene' AND score >= 0.9")
def l02_edge_filter(spark, d):
    return table(spark, d, "kg_edges").filter("edge_type = 'drug_targets_gene' and score >= 0.9").select("edge_id", "source_id", "target_id", "score").distinct()


@query(GRAPH + HAY + """, q AS (SELECT * FROM (VALUES ('gene:x005'), ('vi'), ('tigolimide publication')) t(query))
SELECT query, r AS rank, id, name, node_type FROM (
  SELECT q.query, n.id, n.name, n.node_type, row_number() OVER (PARTITION BY q.query ORDER BY (lower(n.name) <> q.query) NULLS LAST, lower(n.name) NULLS LAST, n.id) AS r
  FROM hay n, q WHERE contains(n.hay, q.query)) WHERE r <= 10
""")
def l03_node_search(spark, d):
    q = spark.createDataFrame([("gene:x005", None), ("vi", None), ("tigolimide publication", None)], "query string, node_type string")
    return graph(spark, d).search(q, limit=10)


@query(GRAPH + f""", q AS {_tenth_sql('Gene')}
SELECT q.id, 'out' AS direction, e.source_id, e.target_id, e.edge_type, e.score FROM q JOIN edges e ON e.source_id = q.id
UNION ALL SELECT q.id, 'in', e.source_id, e.target_id, e.edge_type, e.score FROM q JOIN edges e ON e.target_id = q.id
""")
def l06_incident_edges(spark, d):
    return slim_graph(spark, d).incident(_tenth(spark, d, "Gene"))


@query(GRAPH + "SELECT e.source_id, n.id, n.name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'drug_targets_gene'")
def l07_drug_targets(spark, d):
    return slim_graph(spark, d).targets("drug_targets_gene")


@query(GRAPH + """SELECT gene, rank, pmid, year FROM (
  SELECT e.target_id AS gene, n.pmid, n.year, row_number() OVER (PARTITION BY e.target_id ORDER BY coalesce(n.year, 0) DESC, n.id) AS rank
  FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.edge_type = 'publication_mentions_gene') WHERE rank <= 5""")
def l09_recent_publications(spark, d):
    kg = slim_graph(spark, d)
    return G.recent_publications(kg)


@query(GRAPH + "SELECT e.source_id, e.target_id, CASE "
       + " ".join(f"WHEN s.node_type = '{a}' AND t.node_type = '{b}' THEN '{e}'" for (a, b), e in EDGE_BETWEEN.items())
       + " END AS edge_type FROM (SELECT DISTINCT source_id, target_id FROM edges) e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id")
def l13_infer_edge_type(spark, d):
    kg = slim_graph(spark, d)
    t = kg.nodes.select("id", "node_type")
    e = kg.edges.select("source_id", "target_id").distinct().join(t.withColumnsRenamed({"id": "source_id", "node_type": "s"}), "source_id").join(t.withColumnsRenamed({"id": "target_id", "node_type": "t"}), "target_id")
    return e.select("source_id", "target_id", edge_type_between(F.col("s"), F.col("t")).alias("edge_type"))


# --- relational queries ----------------------------------------------------------------------------------------------


@query(GRAPH + """, s AS (SELECT g.target_id AS disease, t.source_id AS drug, sum(g.score * t.score) AS score, string_agg(DISTINCT g.source_id, '|' ORDER BY g.source_id) AS genes
  FROM edges g JOIN edges t ON t.target_id = g.source_id AND t.edge_type = 'drug_targets_gene' WHERE g.edge_type = 'gene_associated_with_disease' GROUP BY ALL)
SELECT disease, drug, round(score, 6) AS score, genes FROM s
WHERE NOT EXISTS (SELECT 1 FROM edges k WHERE k.edge_type = 'drug_treats_disease' AND k.source_id = s.drug AND k.target_id = s.disease) AND score >= 0.5
""")
def q01_repurposing(spark, d):
    r = slim_graph(spark, d).repurposing(min_score=0.5)
    return r.select("disease", "drug", F.round("score", 6).alias("score"), F.array_join("genes", "|").alias("genes"))


@query(GRAPH + f""", q AS {_tenth_sql('Disease')},
b AS (SELECT DISTINCT source_id AS id, target_id AS other FROM edges WHERE source_id <> target_id UNION SELECT DISTINCT target_id, source_id FROM edges WHERE source_id <> target_id),
l1 AS (SELECT q.id AS seed, b.other AS id FROM q JOIN b ON b.id = q.id),
l2 AS (SELECT DISTINCT l1.seed, b.other AS id FROM l1 JOIN b ON b.id = l1.id),
a AS (SELECT id AS seed, id, 0 AS level FROM q UNION ALL SELECT seed, id, 1 FROM l1 UNION ALL SELECT seed, id, 2 FROM l2)
SELECT seed, id, min(level) AS level FROM a GROUP BY ALL
""")
def q04_ego_levels(spark, d):
    return slim_graph(spark, d).hops(_tenth(spark, d, "Disease"), radius=2)


def _path_pairs(spark, d):
    a, b = _tenth(spark, d, "Drug"), _tenth(spark, d, "Phenotype")
    na = G.numbered(a, "source")
    nb = G.numbered(b, "target")
    return na.join(nb, "n").select("source", "target")


@query(GRAPH + """, pg AS (SELECT DISTINCT source_id AS publication, target_id AS gene FROM edges WHERE edge_type = 'publication_mentions_gene'),
pd AS (SELECT DISTINCT source_id AS publication, target_id AS disease FROM edges WHERE edge_type = 'publication_mentions_disease'),
gd AS (SELECT DISTINCT source_id AS gene, target_id AS disease FROM edges WHERE edge_type = 'gene_associated_with_disease')
SELECT disease, gene, publication FROM gd JOIN pg USING (gene) JOIN pd USING (publication, disease)
""")
def q06_cosupport(spark, d):
    return slim_graph(spark, d).supporting_publications()


@query(GRAPH + f""", q AS {_tenth_sql('Gene')},
b AS (SELECT DISTINCT source_id AS id, target_id AS other FROM edges WHERE source_id <> target_id UNION SELECT DISTINCT target_id, source_id FROM edges WHERE source_id <> target_id),
l1 AS (SELECT DISTINCT q.id AS seed, b.other AS id FROM q JOIN b ON b.id = q.id),
l2 AS (SELECT DISTINCT l1.seed, b.other AS id FROM l1 JOIN b ON b.id = l1.id),
l3 AS (SELECT DISTINCT l2.seed, b.other AS id FROM l2 JOIN b ON b.id = l2.id),
a AS (SELECT id AS seed, id, 0 AS level FROM q UNION ALL SELECT seed, id, 1 FROM l1 UNION ALL SELECT seed, id, 2 FROM l2 UNION ALL SELECT seed, id, 3 FROM l3),
m AS (SELECT seed, id, min(level) AS level FROM a GROUP BY ALL)
SELECT seed, m.id, level FROM m JOIN nodes n ON n.id = m.id WHERE n.node_type = 'Disease' AND level >= 2
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_type = 'gene_associated_with_disease' AND e.source_id = m.seed AND e.target_id = m.id)
""")
def q08_structural_holes(spark, d):
    return slim_graph(spark, d).structural_holes(_tenth(spark, d, "Gene"), target_type="Disease", relation="gene_associated_with_disease")


@query(GRAPH + """SELECT e.source_id AS drug, string_agg(DISTINCT n.name, ', ' ORDER BY n.name) AS mechanism
FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'drug_targets_gene' AND n.name IS NOT NULL GROUP BY ALL""")
def q12_target_mechanisms(spark, d):
    t = slim_graph(spark, d).targets("drug_targets_gene").filter("name is not null")
    return t.groupBy(F.col("source_id").alias("drug")).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("mechanism"))


@query(GRAPH + """SELECT 'node' AS what, node_type AS type, count(*) AS n FROM nodes WHERE node_type IS NOT NULL GROUP BY ALL UNION ALL SELECT 'node', NULL, count(*) FROM nodes
UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'edge', NULL, count(*) FROM edges""")
def q13_stats(spark, d):
    return slim_graph(spark, d).stats()


# --- analytics -------------------------------------------------------------------------------------------------------

_DEGREE = """, deg AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM und UNION ALL SELECT v FROM und) GROUP BY id),
cen AS (SELECT u.id, coalesce(degree, 0) AS degree, coalesce(degree, 0) / ((SELECT count(*) FROM universe) - 1) AS centrality FROM universe u LEFT JOIN deg USING (id))
"""


@query(GRAPH + _DEGREE + "SELECT id, degree, round(centrality, 9) AS centrality FROM cen")
def a01_degree_centrality(spark, d):
    return A.degree_centrality(slim_graph(spark, d)).select("id", "degree", F.round("centrality", 9).alias("centrality"))


def _pagerank_sql(most: int = 60) -> str:
    """SQL of ranks (id, rank): rounds until, at a fifth one, ranks have moved by less than a millionth of the number of nodes."""
    s = GRAPH + """, w AS MATERIALIZED (SELECT source_id, target_id, count(*) AS w FROM edges GROUP BY ALL),
o AS (SELECT source_id, sum(w) AS t FROM w GROUP BY ALL), p AS MATERIALIZED (SELECT source_id, target_id, w / t AS p FROM w JOIN o USING (source_id)),
n AS (SELECT count(*) AS n FROM universe), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT n FROM n) AS rank FROM universe)"""
    for k in range(1, most + 1):
        s += f""", l{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT source_id FROM o)),
r{k} AS MATERIALIZED (SELECT u.id, 0.85::DOUBLE * (coalesce(c.came, 0) + (SELECT lost FROM l{k}) / (SELECT n FROM n)) + 0.15::DOUBLE / (SELECT n FROM n) AS rank
  FROM universe u LEFT JOIN (SELECT target_id AS id, sum(rank * p) AS came FROM r{k - 1} JOIN p ON p.source_id = r{k - 1}.id GROUP BY ALL) c USING (id))"""
    fifth = range(5, most + 1, 5)
    s += ", moved AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.rank - b.rank)) AS moved FROM r{k} a JOIN r{k - 1} b USING (id)" for k in fifth) + ")"
    return s + ", ranks AS MATERIALIZED (SELECT id, rank FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in fifth) + ") WHERE k = (SELECT min(k) FROM moved WHERE moved < 1e-6 * (SELECT n FROM n)))"


def _betweenness_sql(levels: int = 14) -> str:
    """SQL of btw (id, betweenness): breadth-first levels from every node, then what flows back along them."""
    s = """, near_ AS MATERIALIZED (SELECT source_id AS id, target_id AS other FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id),
f0 AS MATERIALIZED (SELECT id AS s, id, 1.0::DOUBLE AS sigma FROM universe)"""
    for k in range(1, levels + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM f{j} x WHERE x.s = f.s AND x.id = n.other)" for j in (k - 1, k - 2) if j >= 0)
        s += f", f{k} AS MATERIALIZED (SELECT f.s, n.other AS id, sum(f.sigma) AS sigma FROM f{k - 1} f JOIN near_ n USING (id) WHERE TRUE {seen} GROUP BY ALL)"
    s += f", d{levels} AS MATERIALIZED (SELECT s, id, sigma, 0.0::DOUBLE AS delta FROM f{levels})"
    for k in range(levels - 1, 0, -1):
        s += f", d{k} AS MATERIALIZED (SELECT f.s, f.id, f.sigma, f.sigma * coalesce(b.part, 0) AS delta FROM f{k} f LEFT JOIN (SELECT d.s, n.other AS id, sum((1 + d.delta) / d.sigma) AS part FROM d{k + 1} d JOIN near_ n USING (id) GROUP BY ALL) b USING (s, id))"
    flows = " UNION ALL ".join(f"SELECT id, delta FROM d{k}" for k in range(1, levels + 1))
    return s + f", btw AS MATERIALIZED (SELECT u.id, coalesce(b.b, 0) / ((SELECT count(*) FROM universe) - 1.0::DOUBLE) / ((SELECT count(*) FROM universe) - 2.0::DOUBLE) AS betweenness FROM universe u LEFT JOIN (SELECT id, sum(delta) AS b FROM ({flows}) GROUP BY ALL) b USING (id))"


@query(_pagerank_sql() + "SELECT id, round(rank, 9) AS rank FROM ranks")
def a03_pagerank(spark, d):
    return A.pagerank(slim_graph(spark, d)).select("id", F.round("rank", 9).alias("rank"))


@query(GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + """, near_ AS MATERIALIZED (SELECT source_id AS id, target_id AS other FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id),
low AS (SELECT id, min(least(id, other)) AS m FROM near_ GROUP BY ALL), roots AS (SELECT id FROM low WHERE m = id),
reach AS (SELECT id AS root, id FROM roots UNION SELECT r.root, n.other FROM reach r JOIN near_ n USING (id))
SELECT u.id, coalesce(min(r.root), u.id) AS component FROM universe u LEFT JOIN reach r USING (id) GROUP BY u.id""")
def a04_components(spark, d):
    return A.components(slim_graph(spark, d))


@query(GRAPH + _DEGREE + "SELECT n.id, n.name, c.degree FROM nodes n JOIN cen c USING (id) WHERE n.node_type = 'Gene' ORDER BY c.degree DESC, n.id LIMIT 10")
def a05_hub_genes(spark, d):
    kg = slim_graph(spark, d)
    return kg.nodes.filter("node_type = 'Gene'").join(A.degree_centrality(kg), "id").orderBy(F.desc("degree"), "id").limit(10).select("id", "name", "degree")


@query(_pagerank_sql() + _DEGREE + _betweenness_sql() + """,
k AS (SELECT n.id, n.name, (SELECT count(*) FROM edges e WHERE e.edge_type = 'drug_targets_gene' AND e.target_id = n.id) AS drugs,
 (SELECT count(*) FROM edges e WHERE e.edge_type = 'gene_in_pathway' AND e.source_id = n.id) AS pathways,
 (SELECT count(*) FROM edges e WHERE e.edge_type = 'gene_associated_with_disease' AND e.source_id = n.id) AS diseases FROM nodes n WHERE n.node_type = 'Gene'),
f AS (SELECT k.*, 0.4 * c.centrality + 0.3 * b.betweenness + 0.3 * r.rank AS combined FROM k JOIN cen c USING (id) JOIN ranks r USING (id) JOIN btw b USING (id))
SELECT id, name, round(combined, 8) AS combined, round(least(1.0, combined + 0.25 * least(drugs, 3) / 3 + 0.15 * least(pathways, 5) / 5 + 0.15 * least(diseases, 5) / 5), 8) AS druggability, drugs, pathways, diseases FROM f
""")
def a06_target_ranking(spark, d):
    kg = slim_graph(spark, d)
    t = A.target_ranking(kg, A.degree_centrality(kg), A.betweenness(kg), A.pagerank(kg))
    return t.withColumns({c: F.round(c, 8) for c in ("combined", "druggability")})


@query(GRAPH + _betweenness_sql() + "SELECT id, round(betweenness, 9) AS betweenness FROM btw")
def a02_betweenness(spark, d):
    """Exact betweenness of every node over all edges."""
    return A.betweenness(slim_graph(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


@query()
def a07_druggability(spark, d):
    """Druggability of genes asked for by id or name."""
    kg = slim_graph(spark, d)
    asked = table(spark, d, "kg_nodes").filter("record_id % 50 = 0 and node_type = 'Gene' and name is not null").select(F.col("name").alias("gene"))
    t = A.target_ranking(kg, A.degree_centrality(kg), A.betweenness(kg), A.pagerank(kg))
    return A.druggability(kg, asked, t).withColumn("druggability", F.round("druggability", 8))


@query()
def a10_largest_communities(spark, d):
    """The ten largest communities with their members."""
    c = A.largest_communities(A.label_communities(slim_graph(spark, d)))
    return c.select("number", "community", "size", F.array_join("members", "|").alias("members"))


@query()
def a08_communities(spark, d):
    return A.label_communities(slim_graph(spark, d))


@query()
def a09_community_summary(spark, d):
    kg = slim_graph(spark, d)
    return A.community_summary(kg, A.label_communities(kg))


def _enrichment(spark, d):
    kg = slim_graph(spark, d)
    members = kg.of_type("gene_in_pathway").select(F.col("target_id").alias("term"), F.col("source_id").alias("gene"))
    q = kg.of_type("gene_associated_with_disease").join(_tenth(spark, d, "Disease").select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("target_id").alias("query"), F.col("source_id").alias("gene"))
    return A.enrichment(q, members, kg.nodes.filter("node_type = 'Gene'").select(F.col("id").alias("gene")))


def _enrichment_sql(kind: str, x: str) -> str:
    """SQL of {x}_pv (query, term, overlap, p): terms of a relation over the genes of query diseases."""
    return f""", {x}_bg AS (SELECT id AS gene FROM nodes WHERE node_type = 'Gene'), {x}_nb AS (SELECT count(*) AS nb FROM {x}_bg),
{x}_q AS (SELECT DISTINCT target_id AS query, source_id AS gene FROM edges WHERE edge_type = 'gene_associated_with_disease' AND target_id IN {_tenth_sql('Disease')}),
{x}_m AS (SELECT DISTINCT target_id AS term, source_id AS gene FROM edges WHERE edge_type = '{kind}' AND source_id IN (SELECT gene FROM {x}_bg)),
{x}_nq AS (SELECT query, count(*) AS nq, count(*) FILTER (WHERE gene NOT IN (SELECT gene FROM {x}_bg)) AS nout FROM {x}_q GROUP BY ALL), {x}_nt AS (SELECT term, count(*) AS nt FROM {x}_m GROUP BY ALL),
{x}_h AS (SELECT query, term, count(*) AS a FROM {x}_q JOIN {x}_m USING (gene) GROUP BY ALL),
{x}_x AS (SELECT query, term, a AS overlap, nq, nt, nq + nt - a + greatest(nb + nout - (nq + nt - a) - nout, 0) AS n FROM {x}_h JOIN {x}_nq USING (query) JOIN {x}_nt USING (term), {x}_nb),
{x}_pv AS MATERIALIZED (SELECT query, term, overlap, least(1.0, (SELECT sum(exp(lgamma(nt + 1) - lgamma(k + 1) - lgamma(nt - k + 1) + lgamma(n - nt + 1) - lgamma(nq - k + 1) - lgamma(n - nt - nq + k + 1) - lgamma(n + 1) + lgamma(nq + 1) + lgamma(n - nq + 1)))
   FROM generate_series(overlap, least(nq, nt)) g(k) WHERE nq - k <= n - nt)) AS p FROM {x}_x)"""


@query(GRAPH + _enrichment_sql("gene_in_pathway", "e") + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY p, term) AS rk, count(*) OVER (PARTITION BY query) AS m FROM e_pv)
SELECT query, term, overlap, round(p, 8) AS p, round(least(1.0, min(p * m / rk) OVER (PARTITION BY query ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 8) AS fdr FROM rk
""")
def a11_enrichment(spark, d):
    return _enrichment(spark, d).withColumns({c: F.round(c, 8) for c in ("p", "fdr")})


@query(GRAPH + _enrichment_sql("gene_in_pathway", "e") + """, ten AS (SELECT DISTINCT term FROM (SELECT term, row_number() OVER (PARTITION BY query ORDER BY round(p, 12), term) AS r FROM e_pv) WHERE r <= 10),
mem AS (SELECT DISTINCT target_id AS term, source_id AS gene FROM edges WHERE edge_type = 'gene_in_pathway')
SELECT e.source_id, e.target_id, e.score, string_agg(a.gene, '|' ORDER BY a.gene) AS genes
FROM edges e JOIN mem a ON a.term = e.source_id JOIN mem b ON b.term = e.target_id AND b.gene = a.gene WHERE e.edge_type = 'pathway_crosstalks_with' AND e.source_id IN (SELECT term FROM ten) AND e.target_id IN (SELECT term FROM ten) GROUP BY ALL
""")
def q10_pathway_crosstalk(spark, d):
    """Crosstalk among the ten pathways most enriched in the genes of query diseases."""
    hits = _enrichment(spark, d).withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.round("p", 12), "term"))).filter("r <= 10")
    return G.pathway_crosstalk(slim_graph(spark, d), hits.select("term").distinct())


@query(GRAPH + f""", q AS {_tenth_sql('Gene')}, s AS MATERIALIZED (SELECT DISTINCT source_id AS id, target_id AS t FROM edges), z AS (SELECT id, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT a.id, c.id AS other, count(*) AS i FROM s a JOIN s c USING (t) WHERE a.id IN (SELECT id FROM q) AND a.id <> c.id GROUP BY ALL),
f AS (SELECT b.id, other, i / (x.n + y.n - i) AS score FROM b JOIN z x ON x.id = b.id JOIN z y ON y.id = b.other)
SELECT id, rank, other, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM f) WHERE rank <= 10
""")
def a14_neighbour_jaccard(spark, d):
    return A.neighbour_jaccard(slim_graph(spark, d), _tenth(spark, d, "Gene")).withColumn("score", F.round("score", 9))


_TOPIC = f"contains(lower(coalesce(title, '')), '{TOPIC}') OR contains(lower(coalesce(abstract, '')), '{TOPIC}')"


@query(f"SELECT year, count(*) AS n FROM pubmed_articles WHERE year IS NOT NULL AND ({_TOPIC}) GROUP BY ALL")
def a17_yearly_counts(spark, d):
    return A.yearly_counts(table(spark, d, "pubmed_articles"), TOPIC)


@query("SELECT round(regr_slope(n, year), 9) AS velocity FROM (SELECT year, count(*) AS n FROM pubmed_articles WHERE year IS NOT NULL GROUP BY ALL)")
def a18_velocity(spark, d):
    return A.velocity(A.yearly_counts(table(spark, d, "pubmed_articles"), "")).select(F.round("velocity", 9).alias("velocity"))


@query("""
WITH w AS (SELECT year, w, count(*) AS n FROM (SELECT year, unnest(regexp_extract_all(lower(abstract), '[A-Za-z0-9_:-]+')) AS w FROM pubmed_articles WHERE year IS NOT NULL) GROUP BY ALL),
y AS (SELECT year, lag(year) OVER (ORDER BY year) AS before FROM (SELECT DISTINCT year FROM w)),
a AS (SELECT w.year AS y, w, n FROM w JOIN y ON y.year = w.year WHERE before IS NOT NULL), b AS (SELECT y.year AS y, w, n AS m FROM w JOIN y ON y.before = w.year)
SELECT y AS year, round(1 - sum(least(coalesce(n, 0), coalesce(m, 0))) / sum(greatest(coalesce(n, 0), coalesce(m, 0))), 9) AS drift FROM a FULL JOIN b USING (y, w) GROUP BY ALL
""")
def a19_lexical_drift(spark, d):
    return A.lexical_drift(table(spark, d, "pubmed_articles")).withColumn("drift", F.round("drift", 9))


@query("""
WITH a AS (SELECT article_id, year, dense_rank() OVER (ORDER BY year DESC) AS r, list_distinct(regexp_extract_all(concat_ws(' ', coalesce(title, ''), coalesce(abstract, '')), '[A-Za-z][A-Za-z0-9_-]{2,}')) AS t FROM pubmed_articles WHERE year IS NOT NULL),
w AS (SELECT r, lower(t) AS term FROM (SELECT r, unnest(t) AS t FROM a) WHERE regexp_matches(t, '[A-Z0-9]')),
n AS (SELECT term, count(*) FILTER (WHERE r <= 2) AS recent, count(*) FILTER (WHERE r > 2) AS historical FROM w GROUP BY ALL)
SELECT term, recent, historical, round((recent - historical) * ln(1 + recent / greatest(historical, 1)), 9) AS score FROM n WHERE recent > historical ORDER BY score DESC, term LIMIT 10
""")
def a20_emerging_terms(spark, d):
    return A.emerging_terms(table(spark, d, "pubmed_articles")).withColumn("score", F.round("score", 9))
