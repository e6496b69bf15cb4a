"""Queries of reports and of requests routed to them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import clinical as C
from ..operators import reports as P
from ..operators.runtime import checkpoint, table
from .context import _articles, _ARTICLES, _questions, _QUESTIONS, _RANKED
from .retrieval import _classify_sql
from .graph import PATHS, _enrichment_sql, _path_pairs, _tenth, _tenth_sql
from .testbed import GRAPH, graph, node_records, slim_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


# --- lookups -----------------------------------------------------------------------------------------------------------


@query(GRAPH + f"SELECT e.source_id AS id, e.target_id AS other, n.name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE n.name IS NOT NULL AND e.edge_type = 'gene_associated_with_disease' AND e.source_id IN {_tenth_sql('Gene')}")
def l08_named_neighbours(spark, d):
    """Named diseases of query genes, an edge each."""
    return P.named_neighbours(slim_graph(spark, d), _tenth(spark, d, "Gene"), "gene_associated_with_disease")


@query(GRAPH + """, q AS (SELECT DISTINCT name AS query FROM kg_nodes WHERE record_id % 50 = 0 AND node_type = 'Gene' AND length(trim(name)) > 0)
SELECT query, rank, id, name FROM (SELECT q.query, n.id, n.name, row_number() OVER (PARTITION BY q.query ORDER BY (lower(n.name) <> lower(trim(q.query))) NULLS LAST, lower(n.name) NULLS LAST, n.id) AS rank
  FROM q JOIN nodes n ON n.node_type = 'Gene' AND contains(lower(concat_ws(' ', n.id, n.name)), lower(trim(q.query)))) WHERE rank <= 5""")
def l05_typed_search(spark, d):
    """Genes whose id or name holds the delivered names of query genes."""
    q = table(spark, d, "kg_nodes").filter("record_id % 50 = 0 and node_type = 'Gene' and length(trim(name)) > 0").select(F.col("name").alias("query"), F.lit("Gene").alias("node_type")).distinct()
    return slim_graph(spark, d).search(q, limit=5).select("query", "rank", "id", "name")


@query(GRAPH + r""", q AS (SELECT DISTINCT name AS query FROM kg_nodes WHERE record_id % 50 = 0 AND length(trim(name)) > 0 UNION SELECT DISTINCT id FROM kg_nodes WHERE record_id % 50 = 1 AND id IS NOT NULL),
k AS (SELECT query, lower(regexp_replace(query, '^\s+|\s+$', '', 'g')) AS k FROM q), a AS (SELECT query, n.id FROM k JOIN nodes n ON n.id = k.query),
b AS (SELECT query, min(n.id) AS id FROM k JOIN nodes n ON lower(regexp_replace(n.name, '^\s+|\s+$', '', 'g')) = k.k WHERE query NOT IN (SELECT query FROM a) GROUP BY ALL),
c AS (SELECT k.query, n.id FROM k JOIN nodes n ON contains(lower(concat_ws(' ', n.id, n.name)), k.k) WHERE query NOT IN (SELECT query FROM a) AND query NOT IN (SELECT query FROM b) QUALIFY row_number() OVER (PARTITION BY k.query ORDER BY (lower(n.name) <> k.k) NULLS LAST, lower(n.name) NULLS LAST, n.id) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def l04_resolve_nodes(spark, d):
    """Delivered names and ids to nodes: by id, else by name, else by text."""
    r = table(spark, d, "kg_nodes")
    names = r.filter("record_id % 50 = 0 and length(trim(name)) > 0").select(F.col("name").alias("query"))
    q = names.unionByName(r.filter("record_id % 50 = 1 and id is not null").select(F.col("id").alias("query"))).distinct().withColumn("node_type", F.lit(None).cast("string"))
    return P.resolve_nodes(slim_graph(spark, d), q)


@query("SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER), 0) AS k FROM events")
def l14_coerce(spark, d):
    return table(spark, d, "events").select("event_id", P.coerce_int(F.col("props")).alias("k"))


@query(r"SELECT request_id, pos, part FROM (SELECT request_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT request_id, CASE WHEN len(p) > 0 THEN p ELSE [condition] END AS p FROM (SELECT DISTINCT request_id, condition, list_filter(list_transform(regexp_split_to_array(condition, ',|;|\band\b'), lambda x: regexp_replace(x, '^[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')), lambda x: x <> '') AS p FROM clinical_intake WHERE condition IS NOT NULL)))")
def c15_listed_names(spark, d):
    """Conditions listed in a field."""
    r = table(spark, d, "clinical_intake").filter("`condition` is not null").select("request_id", "condition").distinct()
    return r.select("request_id", F.posexplode(P.split_list(F.col("condition"))).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


# --- relational ----------------------------------------------------------------------------------------------------------


@query(GRAPH + "," + PATHS.format(pairs=f"(SELECT s.id AS source, t.id AS target FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM {_tenth_sql('Drug')}) s JOIN (SELECT id, row_number() OVER (ORDER BY id) AS n FROM {_tenth_sql('Phenotype')}) t USING (n))")
       + "SELECT source, target, CAST(length AS INTEGER) AS length, array_to_string(path, '>') AS path FROM paths")
def q03_shortest_paths(spark, d):
    p = slim_graph(spark, d).shortest_paths(_path_pairs(spark, d))
    return p.select("source", "target", F.col("length").cast("int").alias("length"), F.array_join("path", ">").alias("path"))


_PAIRS = "(SELECT DISTINCT source_id AS source, target_id AS target FROM hypotheses WHERE hypothesis_id % 50 = 0 AND source_id IS NOT NULL AND target_id IS NOT NULL)"


@query(GRAPH + "," + PATHS.format(pairs=_PAIRS) + f"""SELECT p.source AS gene, p.target AS disease, coalesce(max(e.score), 0.0) AS score, CAST(first(x.length) AS INTEGER) AS length, array_to_string(first(x.path), '>') AS path FROM {_PAIRS} p
LEFT JOIN edges e ON e.source_id = p.source AND e.target_id = p.target AND e.edge_type = 'gene_associated_with_disease' LEFT JOIN paths x ON x.source = p.source AND x.target = p.target GROUP BY p.source, p.target""")
def q02_gene_disease_evidence(spark, d):
    """Direct score and shortest path of query hypotheses."""
    h = table(spark, d, "hypotheses").filter("hypothesis_id % 50 = 0 and source_id is not null and target_id is not null").select(F.col("source_id").alias("gene"), F.col("target_id").alias("disease"))
    e = P.gene_disease_evidence(slim_graph(spark, d), h)
    return e.select("gene", "disease", "score", "length", F.array_join("path", ">").alias("path"))


_BRIDGE = """m AS MATERIALIZED (SELECT DISTINCT e.source_id AS p, e.target_id AS x FROM edges e JOIN nodes n ON n.id = e.target_id AND n.node_type = CASE e.edge_type WHEN 'publication_mentions_gene' THEN 'Gene' ELSE 'Disease' END
  WHERE e.edge_type IN ('publication_mentions_gene', 'publication_mentions_disease'))"""


@query(GRAPH + "," + _BRIDGE + """SELECT h.source_id, h.target_id, string_agg(DISTINCT n.pmid, '|' ORDER BY n.pmid) AS pmids FROM (SELECT DISTINCT source_id, target_id FROM hypotheses) h
JOIN m a ON a.x = h.source_id JOIN m b ON b.x = h.target_id AND b.p = a.p JOIN nodes n ON n.id = a.p WHERE n.pmid IS NOT NULL GROUP BY ALL""")
def q07_literature_bridge(spark, d):
    """PMIDs that mention both ends, genes or diseases, of hypotheses."""
    b = P.literature_bridge(slim_graph(spark, d), table(spark, d, "hypotheses"))
    return b.withColumn("pmids", F.array_join("pmids", "|"))


@query(GRAPH + "SELECT DISTINCT h.source_id, h.target_id, EXISTS (SELECT 1 FROM und WHERE u = least(h.source_id, h.target_id) AND v = greatest(h.source_id, h.target_id)) AS linked FROM hypotheses h")
def q11_edge_exists(spark, d):
    return P.edges_exist(slim_graph(spark, d), table(spark, d, "hypotheses"))


@query(GRAPH + """, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id)
SELECT u.id, coalesce(n.name, u.id) AS label, coalesce(n.node_type, 'unknown') AS "group", coalesce(d.degree, 0) AS degree, round(14 + 8 * ln(1 + coalesce(d.degree, 0)), 2) AS size FROM universe u LEFT JOIN d USING (id) LEFT JOIN nodes n USING (id)""")
def i20_vis_nodes(spark, d):
    return P.vis_nodes(slim_graph(spark, d))


@query(GRAPH + "SELECT 'edge-' || row_number() OVER (ORDER BY source_id, target_id, edge_type) AS id, source_id, target_id, replace(edge_type, '_', ' ') AS label, score FROM edges")
def i20_vis_edges(spark, d):
    return P.vis_edges(slim_graph(spark, d))


# --- reports -------------------------------------------------------------------------------------------------------------


@query()
def o15_gene_report(spark, d):
    """Query genes with what they go with and their place in the network."""
    kg = slim_graph(spark, d)
    ranking = A.target_ranking(kg, A.degree_centrality(kg), A.betweenness(kg), A.pagerank(kg))
    r = P.gene_reports(kg, _tenth(spark, d, "Gene"), ranking)
    return r.select("id", *[F.array_join(c, "|").alias(c) for c in ("diseases", "drugs", "pathways")], F.round("druggability", 6).alias("druggability"), "summary")


@query(GRAPH + f""", q AS {_tenth_sql('Gene')}, x AS (SELECT e.source_id AS id, n.name, 'diseases' AS what FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'gene_associated_with_disease'
 UNION ALL SELECT e.target_id, n.name, 'drugs' FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.edge_type = 'drug_targets_gene' UNION ALL SELECT e.source_id, n.name, 'pathways' FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'gene_in_pathway'),
p AS (SELECT e.target_id AS id, n.pmid, row_number() OVER (PARTITION BY e.target_id ORDER BY coalesce(n.year, 0) DESC, n.id) AS rank FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.edge_type = 'publication_mentions_gene')
SELECT g.id, """ + ", ".join(f"coalesce((SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM x WHERE x.id = g.id AND what = '{w}'), '') AS {w}" for w in ("diseases", "drugs", "pathways")) + """,
coalesce((SELECT string_agg(pmid, '|' ORDER BY rank) FROM p WHERE p.id = g.id AND rank <= 5), '') AS papers FROM nodes g WHERE g.node_type = 'Gene' AND g.id IN (SELECT id FROM q)""")
def o15_gene_lists(spark, d):
    """Query genes with the names of their diseases, drugs and pathways and their latest papers."""
    kg = slim_graph(spark, d)
    none = kg.nodes.select("id", F.lit(0.0).alias("combined"), F.lit(0.0).alias("druggability"))
    r = P.gene_reports(kg, _tenth(spark, d, "Gene"), none)
    return r.select("id", *[F.array_join(c, "|").alias(c) for c in ("diseases", "drugs", "pathways", "papers")])


_MENTIONS = r"""toks AS (SELECT query, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM ask),
nm AS (SELECT id, name, node_type, regexp_extract_all(lower(name), '[\p{L}\p{N}_]+') AS w FROM nodes WHERE name IS NOT NULL), nw AS (SELECT id, node_type, length(name) AS len, len(w) AS n, array_to_string(w, ' ') AS key FROM nm WHERE len(w) > 0),
runs AS (SELECT query, i - 1 AS place, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT query, w, unnest(generate_series(1, len(w))) AS i FROM toks), (SELECT DISTINCT n FROM nw) WHERE i + n - 1 <= len(w)),
hit AS (SELECT query, id, node_type, len, min(place) AS place FROM runs JOIN nw USING (key, n) GROUP BY ALL),
ment AS MATERIALIZED (SELECT query, id, node_type, place, row_number() OVER (PARTITION BY query ORDER BY place, CASE WHEN node_type = 'Publication' THEN 1 ELSE 0 END, len DESC, id) AS rank FROM hit)"""


@query(GRAPH + "," + _QUESTIONS + "," + _MENTIONS + 'SELECT query AS doc, rank, id, place AS "at" FROM ment WHERE rank <= 5')
def l10_mentions(spark, d):
    """Nodes named in questions as whole words."""
    kg = slim_graph(spark, d)
    m = C.mentions(_questions(spark, d).select(F.col("query").alias("doc"), "text"), kg.nodes.select("id", "name", F.col("node_type").alias("kind")))
    return m.withColumns({c: F.col(c).cast("long") for c in ("rank", "at")})


@query()
def l10_document_mentions(spark, d):
    """Vocabulary entries named in documents as whole words."""
    names = table(spark, d, "vocab_terms").select(F.col("term_id").alias("id"), "name", "kind").distinct()
    return C.mentions(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), names)


@query()
def o16_explore(spark, d):
    """Questions about the graph answered by a path or by what is around."""
    return P.explore(graph(spark, d), _questions(spark, d)).select("query", "mode", F.array_join("nodes", ">").alias("nodes"), "n", "confidence", "summary")


@query(GRAPH + _enrichment_sql("gene_in_pathway", "ep") + _enrichment_sql("gene_associated_with_disease", "ed") + """,
tp AS (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY round(p, 12), term) AS r FROM ep_pv), td AS (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY round(p, 12), term) AS r FROM ed_pv),
c AS (SELECT a.query, count(*) AS n FROM tp a JOIN edges e ON e.source_id = a.term AND e.edge_type = 'pathway_crosstalks_with' JOIN tp b ON b.term = e.target_id AND b.query = a.query WHERE a.r <= 10 AND b.r <= 10 GROUP BY ALL)
SELECT k.query, coalesce((SELECT string_agg(term, '|' ORDER BY r) FROM tp WHERE tp.query = k.query AND r <= 10), '') AS pathways, coalesce((SELECT string_agg(term, '|' ORDER BY r) FROM td WHERE td.query = k.query AND r <= 10), '') AS diseases, coalesce(c.n, 0) AS crosstalk,
 CAST(CASE WHEN EXISTS (SELECT 1 FROM tp WHERE tp.query = k.query) THEN 0.75 ELSE 0.3 END AS DOUBLE) AS confidence FROM (SELECT DISTINCT query FROM ep_q) k LEFT JOIN c USING (query)""")
def o17_pathway_analysis(spark, d):
    """Genes of query diseases by pathways and diseases, with crosstalk among the pathways."""
    kg = slim_graph(spark, d)
    q = kg.of_type("gene_associated_with_disease").join(_tenth(spark, d, "Disease").select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("target_id").alias("query"), F.col("source_id").alias("gene"))
    return P.pathway_analysis(kg, q).select("query", F.array_join("pathways", "|").alias("pathways"), F.array_join("diseases", "|").alias("diseases"), "crosstalk", "confidence")


def _listed(spark, d):
    """Mechanisms of drug nodes by the drug list."""
    ids = table(spark, d, "kg_nodes").filter("chembl_id is not null").groupBy("id").agg(F.max_by("chembl_id", F.struct("updated_at", "record_id")).alias("chembl_id"))
    return ids.join(table(spark, d, "chembl_drugs").filter("mechanism is not null").select("chembl_id", "mechanism"), "chembl_id").select("id", "mechanism")


_MECHANISMS = """mn AS (SELECT e.source_id AS drug, n.name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'drug_targets_gene' AND n.name IS NOT NULL), mc AS (SELECT chembl_id, min(mechanism) AS mechanism FROM chembl_drugs WHERE mechanism IS NOT NULL GROUP BY ALL),
mk AS (SELECT id, chembl_id FROM kg_nodes WHERE chembl_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, record_id DESC) = 1),
mech AS MATERIALIZED (SELECT n.id, n.name, coalesce(mc.mechanism, (SELECT string_agg(DISTINCT mn.name, ', ' ORDER BY mn.name) FROM mn WHERE mn.drug = n.id)) AS mechanism FROM nodes n LEFT JOIN mk USING (id) LEFT JOIN mc ON mc.chembl_id = mk.chembl_id WHERE n.node_type = 'Drug')"""


@query(GRAPH + "," + _MECHANISMS + "SELECT id, mechanism FROM mech")
def c17_mechanisms(spark, d):
    """A drug's mechanism from the drug list, else the names of its targets."""
    return P.mechanisms(slim_graph(spark, d), _listed(spark, d))


@query(GRAPH + "," + _MECHANISMS + """, side AS (SELECT e.source_id AS id, n.name AS effect, max(e.score) AS s FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'drug_causes_side_effect' AND n.name IS NOT NULL GROUP BY ALL),
five AS (SELECT id, effect, row_number() OVER (PARTITION BY id ORDER BY s DESC, effect) AS r FROM side), se AS (SELECT id, string_agg(effect, ', ' ORDER BY r) AS effects FROM five WHERE r <= 5 GROUP BY ALL),
ci AS (SELECT e.source_id AS id, string_agg(DISTINCT n.name, '|' ORDER BY n.name) AS against FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'drug_contraindicated_for' AND n.name IS NOT NULL GROUP BY ALL),
dd AS (SELECT id, count(DISTINCT o) AS n FROM (SELECT source_id AS id, target_id AS o FROM edges WHERE edge_type = 'drug_interacts_with_drug' AND source_id <> target_id UNION ALL SELECT target_id, source_id FROM edges WHERE edge_type = 'drug_interacts_with_drug' AND source_id <> target_id) GROUP BY ALL)
SELECT m.id, coalesce(ci.against, '') AS contraindicated, coalesce(dd.n, 0) AS interactions, '- ' || coalesce(m.name, m.id) || ': side effects=' || coalesce(se.effects, 'none reported') || '; mechanisms=' || coalesce(m.mechanism, 'no mechanism available') || '.' AS summary
FROM mech m LEFT JOIN se USING (id) LEFT JOIN ci USING (id) LEFT JOIN dd USING (id)""")
def o18_drug_reports(spark, d):
    """Every drug with side effects, mechanism, contraindications and interactions."""
    return P.drug_reports(slim_graph(spark, d), _listed(spark, d)).select("id", F.array_join("contraindicated", "|").alias("contraindicated"), "interactions", "summary")


# --- clinical ------------------------------------------------------------------------------------------------------------

_CASES = """cm AS MATERIALIZED (SELECT source_id AS "case", target_id AS phenotype, max(score) AS score FROM edges WHERE edge_type = 'gene_associated_with_phenotype' GROUP BY ALL),
ca AS MATERIALIZED (SELECT source_id AS disease, target_id AS phenotype, score AS s2 FROM edges WHERE edge_type = 'disease_has_phenotype'),
cs AS MATERIALIZED (SELECT "case", disease, sum(score * s2) AS score FROM cm JOIN ca USING (phenotype) GROUP BY ALL)"""


def _matches(kg):
    return kg.of_type("gene_associated_with_phenotype").groupBy(F.col("source_id").alias("case"), F.col("target_id").alias("phenotype")).agg(F.max("score").alias("score"))


@query(GRAPH + "," + _CASES + 'SELECT "case", disease, round(score, 6) AS score FROM cs')
def c08_graph_scores(spark, d):
    """Diseases scored by the phenotype edges of the graph."""
    kg = slim_graph(spark, d)
    return P.graph_scores(kg, _matches(kg)).withColumn("score", F.round("score", 6))


_DIAGNOSES = GRAPH + "," + _CASES + f""", ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY round(score, 9) DESC, disease) AS rank FROM cs) WHERE rank <= 5),
diag AS MATERIALIZED (SELECT ck."case", rank, ck.disease, n.name, ck.score FROM ck LEFT JOIN nodes n ON n.id = ck.disease WHERE ck."case" IN {_tenth_sql('Gene')}),
terms AS MATERIALIZED (SELECT DISTINCT m."case", n.name AS term FROM cm m JOIN nodes n ON n.id = m.phenotype WHERE length(n.name) > 0 AND m."case" IN (SELECT "case" FROM diag)),
sup AS MATERIALIZED (SELECT g."case", g.disease, string_agg(DISTINCT n.name, '|' ORDER BY n.name) AS support FROM diag g JOIN edges e ON e.source_id = g.disease AND e.edge_type = 'disease_has_phenotype' JOIN nodes n ON n.id = e.target_id AND n.node_type = 'Phenotype'
  WHERE EXISTS (SELECT 1 FROM terms t WHERE t."case" = g."case" AND (contains(lower(n.name), lower(t.term)) OR contains(lower(t.term), lower(n.name)))) GROUP BY ALL)"""


def _diagnoses(spark, d, kg, genes=None):
    """The five best diseases of query genes' phenotypes, or those of ``genes`` (id), and the phenotypes' names."""
    m = _matches(kg)
    assoc = kg.of_type("disease_has_phenotype").select(F.col("target_id").alias("phenotype"), F.col("source_id").alias("disease"), "score")
    q = (_tenth(spark, d, "Gene") if genes is None else genes).select(F.col("id").alias("case"))
    best = C.rank_diseases(m.join(q, "case", "left_semi"), assoc, top=5).join(kg.nodes.select(F.col("id").alias("disease"), "name"), "disease", "left")
    diag = checkpoint(best.select("case", "rank", "disease", "name", "score"))
    terms = m.join(diag.select("case").distinct(), "case", "left_semi").join(kg.nodes.filter("length(name) > 0").select(F.col("id").alias("phenotype"), F.col("name").alias("term")), "phenotype").select("case", "term").distinct()
    return diag, checkpoint(terms)


@query(_DIAGNOSES + 'SELECT "case", disease, support FROM sup')
def c10_name_support(spark, d):
    """Phenotypes of diagnoses whose names hold, or stand in, a case's terms."""
    kg = slim_graph(spark, d)
    diag, terms = _diagnoses(spark, d, kg)
    return P.name_support(kg, terms, diag).withColumn("support", F.array_join("support", "|"))


_EVIDENCE = _DIAGNOSES + """, finds AS (SELECT "case", string_agg(term, ' ' ORDER BY term) AS findings FROM terms GROUP BY ALL),
top3 AS MATERIALIZED (SELECT g.*, f.findings, g."case" || '#' || g.rank AS query FROM diag g LEFT JOIN finds f USING ("case") WHERE rank <= 3),
ask AS MATERIALIZED (SELECT query, concat_ws(' ', name, findings) AS text FROM top3),""" + _ARTICLES + "," + _RANKED + """,
ev AS (SELECT t."case", t.disease, c.pmid, 0 AS kind, t.rank, r.rank AS hit, '' AS id FROM ranked r JOIN top3 t USING (query) JOIN corpus c USING (doc) WHERE r.rank <= 2
  UNION ALL SELECT t."case", t.disease, n.pmid, 1, t.rank, 0, n.id FROM top3 t JOIN edges e ON e.target_id = t.disease AND e.edge_type = 'publication_mentions_disease' JOIN nodes n ON n.id = e.source_id),
ev1 AS (SELECT * FROM ev WHERE pmid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case", pmid ORDER BY kind, rank, hit, id, disease) = 1 UNION ALL SELECT * FROM ev WHERE pmid IS NULL),
evid AS MATERIALIZED (SELECT * FROM (SELECT "case", row_number() OVER (PARTITION BY "case" ORDER BY kind, rank, hit, id, disease) AS place, disease, pmid FROM ev1) WHERE place <= 8)"""


def _evidence(spark, d, kg, diag, terms):
    finds = terms.groupBy("case").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("findings"))
    return P.diagnosis_literature(kg, _articles(spark, d), diag.join(finds, "case", "left"))


@query(_EVIDENCE + 'SELECT "case", place, disease, pmid FROM evid')
def r25_diagnosis_literature(spark, d):
    """Literature of the three best diagnoses of each case."""
    kg = slim_graph(spark, d)
    diag, terms = _diagnoses(spark, d, kg)
    return _evidence(spark, d, kg, diag, terms)


_CITED = _EVIDENCE + """, cites AS (SELECT "case", string_agg(DISTINCT pmid, '|' ORDER BY pmid) AS pmids, count(DISTINCT pmid) AS n FROM (
  SELECT g."case", n.pmid FROM diag g JOIN edges e ON e.target_id = g.disease AND e.edge_type = 'publication_mentions_disease' JOIN nodes n ON n.id = e.source_id UNION ALL SELECT "case", pmid FROM evid) WHERE pmid IS NOT NULL GROUP BY ALL)"""


@query(_CITED + 'SELECT "case", pmids FROM cites')
def c16_diagnosis_citations(spark, d):
    """PMIDs of diagnoses and of their evidence."""
    kg = slim_graph(spark, d)
    diag, terms = _diagnoses(spark, d, kg)
    return P.diagnosis_citations(kg, diag, _evidence(spark, d, kg, diag, terms)).withColumn("pmids", F.array_join("pmids", "|"))


@query(_CITED + """SELECT g."case", count(*) AS diagnoses, coalesce(any_value(c.pmids), '') AS citations, round(greatest(0, least(0.95, max(g.score) + least(coalesce(any_value(c.n), 0), 5) / 25.0)), 6) AS confidence FROM diag g LEFT JOIN cites c USING ("case") GROUP BY g."case" """)
def o19_clinician_report(spark, d):
    """Cases with their diagnoses, citations and a confidence."""
    kg = slim_graph(spark, d)
    diag, terms = _diagnoses(spark, d, kg)
    r = P.clinician_reports(diag, P.diagnosis_citations(kg, diag, _evidence(spark, d, kg, diag, terms)), P.name_support(kg, terms, diag))
    return r.select("case", "diagnoses", F.array_join("citations", "|").alias("citations"), F.round("confidence", 6).alias("confidence"))


@query()
def o25_narratives(spark, d):
    """Reports as text: every gene as a case and every hypothesis."""
    kg = slim_graph(spark, d)
    diag, terms = _diagnoses(spark, d, kg, node_records(spark, d).filter("node_type = 'Gene'").select("id").distinct())
    cases = P.clinician_reports(diag, P.diagnosis_citations(kg, diag, _evidence(spark, d, kg, diag, terms)), P.name_support(kg, terms, diag)).select(F.lit("case").alias("what"), F.col("case").alias("id"), F.col("summary").alias("text"))
    h = table(spark, d, "hypotheses").filter("source_id is not null and target_id is not null and score is not null and not isnan(score)")
    h = h.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.max("score").alias("link"))
    paths = checkpoint(kg.shortest_paths(h.select(F.col("src").alias("source"), F.col("dst").alias("target"))).select(F.col("source").alias("src"), F.col("target").alias("dst"), "path"))
    hyp = P.hypothesis_reports(kg, h.join(paths, ["src", "dst"]))
    return cases.unionByName(hyp.select(F.lit("hypothesis").alias("what"), F.concat_ws(">", "src", "dst").alias("id"), F.col("statement").alias("text")))


# --- requests ------------------------------------------------------------------------------------------------------------


def _requests(spark, d):
    """Every hypothesis whose id is divisible by 50 asks for several things about its ends."""
    q = _questions(spark, d)
    return q.select("query", F.concat(F.when(F.col("query") % 100 == 0, "").otherwise("Find a gene report and then "), F.lower(F.substring("text", 1, 1)), F.substring("text", 2, 10_000), F.lit(" Show the pathway enrichment; list papers")).alias("text"))


@query(GRAPH + "," + _QUESTIONS + "," + _MENTIONS.replace("WHERE name IS NOT NULL)", "WHERE name IS NOT NULL AND node_type IS NOT NULL)") + f"""SELECT a.query, coalesce({_classify_sql('lower(a.text)')}, CASE WHEN m.node_type = 'Gene' AND contains(lower(a.text), 'drug') AND contains(lower(a.text), 'target') THEN 'graph_explorer'
 WHEN m.node_type = 'Gene' THEN 'geneticist' WHEN m.node_type = 'Drug' THEN 'pharmacologist' WHEN m.node_type = 'Disease' THEN 'literature' WHEN m.node_type = 'Pathway' THEN 'pathway_analyst' END, 'router') AS task FROM ask a LEFT JOIN ment m ON m.query = a.query AND m.rank = 1""")
def o02_route(spark, d):
    """Requests by kind: keywords, else the first node named."""
    return P.route(slim_graph(spark, d), _questions(spark, d)).select("query", "task")


@query()
def o03_all_tasks(spark, d):
    """All kinds of task in requests with several steps."""
    return P.route(slim_graph(spark, d), _requests(spark, d)).select("query", F.array_join("tasks", "|").alias("tasks"))


@query()
def o06_decompose(spark, d):
    """Requests as tasks with the nodes they name."""
    t = P.decompose(slim_graph(spark, d), _requests(spark, d))
    return t.select("query", "pos", "task", "clause", "priority", F.array_join("nodes", "|").alias("nodes"))


@query()
def o10_workflow(spark, d):
    """Requests routed, taken apart, answered, verified and put together."""
    kg = graph(spark, d)
    docs, articles = _articles(spark, d), table(spark, d, "pubmed_articles")
    ranking = A.target_ranking(kg, A.degree_centrality(kg), A.betweenness(kg), A.pagerank(kg))
    r = P.run_workflow(kg, docs, _requests(spark, d), P.default_specialists(kg, docs, articles, ranking, _listed(spark, d)))
    return r.select("query", "tasks", "claims", "supported", F.round("confidence", 6).alias("confidence"), F.array_join("citations", "|").alias("citations"), "response")
