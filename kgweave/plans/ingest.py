"""Queries of building, storing and reloading graphs, corpora and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import ingest as I
from ..operators import retrieval as R
from ..operators.graph import KnowledgeGraph
from ..operators.runtime import checkpoint, table
from ..sources import readers as S
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


def _store(spark, name: str) -> str:
    """A folder beside the session's checkpoints."""
    checkpoint(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/stores/{name}"


def _genes(spark, d):
    """Symbols of genes that are associated with anything: the seeds."""
    a = table(spark, d, "disease_associations").select("ensembl_id").distinct()
    return table(spark, d, "gene_info").join(a, "ensembl_id", "left_semi").filter("ensembl_id is not null").select(F.col("ensembl_id").alias("gene"))


def _associations(spark, d):
    return table(spark, d, "disease_associations").select(F.col("ensembl_id").alias("gene"), "disease_id", "disease_name", "score")


def _treatments(spark, d):
    return table(spark, d, "drug_associations").select("disease_id", "drug_id", "drug_name", "phase", "status", "mechanism")


_ASSOCIATED = """WITH s AS (SELECT DISTINCT g.ensembl_id AS gene FROM gene_info g JOIN disease_associations a USING (ensembl_id)),
o AS (SELECT ensembl_id AS gene, disease_id, max(score) AS score FROM disease_associations WHERE score IS NOT NULL AND NOT isnan(score) AND disease_id IS NOT NULL AND ensembl_id IN (SELECT gene FROM s) GROUP BY ALL),
best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY gene ORDER BY score DESC, disease_id) <= 5),
t AS (SELECT disease_id, drug_id, max(phase) AS phase FROM drug_associations WHERE drug_id IS NOT NULL AND disease_id IN (SELECT disease_id FROM best) GROUP BY ALL),
given AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY disease_id ORDER BY phase DESC NULLS LAST, drug_id) <= 3),
e AS (SELECT 'gene:' || lower(gene) AS source_id, 'disease:' || lower(disease_id) AS target_id, 'gene_associated_with_disease' AS edge_type, score FROM best
  UNION ALL SELECT 'drug:' || lower(drug_id), 'disease:' || lower(disease_id), 'drug_treats_disease', 0.8::DOUBLE FROM given)
"""


@query(_ASSOCIATED + "SELECT source_id, target_id, edge_type, max(score) AS score FROM e GROUP BY ALL")
def i07_ingest_associations(spark, d):
    """Each gene's five best diseases and each such disease's three first drugs as edges."""
    e = I.ingest_associations(_genes(spark, d), _associations(spark, d), _treatments(spark, d))[1]
    return e.groupBy("source_id", "target_id", "edge_type").agg(F.max("score").alias("score"))


@query(GRAPH + """SELECT 'gene:' || lower(source_id) AS source_id, 'gene:' || lower(target_id) AS target_id, 'gene_interacts_with_gene' AS edge_type, score FROM edges WHERE edge_type = 'gene_interacts_with_gene'""")
def i08_ingest_interactions(spark, d):
    """Interaction responses, written from the graph's edges, read and ingested."""
    e = slim_graph(spark, d).of_type("gene_interacts_with_gene")
    row = F.struct(F.col("source_id").alias("preferredName_A"), F.col("target_id").alias("preferredName_B"), "score")
    rows = S.interactions(e.select(F.to_json(F.array(row)).alias("payload")))
    return I.ingest_interactions(rows)[1].select("source_id", "target_id", "edge_type", "score")


_SYMBOLS = "SELECT DISTINCT symbol AS gene FROM gene_info WHERE symbol IS NOT NULL AND regexp_full_match(symbol, '[A-Za-z0-9_:-]+')"
_NAMED = f"""g AS ({_SYMBOLS}), a AS (SELECT pmid, max(title) AS title, max(abstract) AS abstract, max(year) AS year FROM pubmed_articles WHERE pmid IS NOT NULL GROUP BY ALL),
w AS (SELECT DISTINCT pmid, year, unnest(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[A-Za-z0-9_:-]+')) AS key FROM a),
named AS (SELECT g.gene, w.pmid FROM w JOIN g ON lower(g.gene) = w.key QUALIFY row_number() OVER (PARTITION BY g.gene ORDER BY w.year DESC NULLS LAST, w.pmid) <= 3)"""


def _symbols(spark, d):
    return table(spark, d, "gene_info").filter("symbol rlike '^[A-Za-z0-9_:-]+$'").select(F.col("symbol").alias("gene")).distinct()


@query("WITH " + _NAMED + "SELECT DISTINCT 'publication:' || lower(pmid) AS source_id, 'gene:' || lower(gene) AS target_id, 'publication_mentions_gene' AS edge_type, 0.6::DOUBLE AS score FROM named")
def i09_ingest_articles(spark, d):
    """The three latest articles that name each gene as publication edges."""
    return I.ingest_articles(_symbols(spark, d), table(spark, d, "pubmed_articles"))[1].select("source_id", "target_id", "edge_type", "score").distinct()


@query(_ASSOCIATED + "," + _NAMED + """, all_e AS (SELECT source_id, target_id, edge_type FROM e UNION SELECT 'publication:' || lower(pmid), 'gene:' || lower(gene), 'publication_mentions_gene' FROM named)
SELECT 'ok' AS status, edge_type AS what, count(*) AS n FROM all_e GROUP BY ALL UNION ALL SELECT 'failed', 'broken', 0 UNION ALL SELECT 'skipped', 'chembl', 0""")
def i10_build(spark, d):
    """A graph built from four sources, of which one fails and one isn't known."""
    def broken():
        bad = spark.range(1).select(F.raise_error(F.lit("no answer")).cast("string").alias("id"))
        return bad, bad

    sources = {"open_targets": lambda: I.ingest_associations(_genes(spark, d), _associations(spark, d), _treatments(spark, d)), "broken": broken, "pubmed": lambda: I.ingest_articles(_symbols(spark, d), table(spark, d, "pubmed_articles"))}
    kg, log = I.build(_genes(spark, d), sources, ["open_targets", "broken", "chembl", "pubmed"])
    told = spark.createDataFrame([(s, name, 0) for name, s in log if s != "ok"], "status string, what string, n long")
    return kg.edges.groupBy(F.lit("ok").alias("status"), F.col("edge_type").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(told)


@query("""WITH r AS (SELECT DISTINCT id, name, sources, updated_at, record_id FROM kg_nodes WHERE id IS NOT NULL),
n AS (SELECT id, name FROM r WHERE name IS NOT NULL AND name <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_id % 2 DESC, updated_at DESC, record_id DESC) = 1),
s AS (SELECT id, string_agg(s, '|' ORDER BY s) AS sources FROM (SELECT DISTINCT id, unnest(sources) AS s FROM r) WHERE s IS NOT NULL GROUP BY id)
SELECT k.id, n.name, coalesce(s.sources, '') AS sources FROM (SELECT DISTINCT id FROM r) k LEFT JOIN n USING (id) LEFT JOIN s USING (id)""")
def i06_upsert(spark, d):
    """Records with an odd number merged into a graph of the even ones."""
    from ..operators.graph import merge_nodes

    rows = node_records(spark, d).select("id", "name", "node_type", "properties", "sources", "updated_at", "record_id")
    half = lambda k: merge_nodes(rows.filter(F.col("record_id") % 2 == k), F.struct("updated_at", "record_id")).drop("updated_at", "record_id")
    none = spark.createDataFrame([], "source_id string, target_id string, edge_type string, score double, properties map<string,string>, sources array<string>")
    n = I.upsert(KnowledgeGraph(half(0), none), half(1), none).nodes
    return n.select("id", "name", F.coalesce(F.array_join("sources", "|"), F.lit("")).alias("sources"))


@query(GRAPH + """SELECT 'node' AS what, node_type AS type, count(*) AS n FROM nodes WHERE node_type IS NOT NULL GROUP BY ALL UNION ALL SELECT 'node', NULL, count(*) FROM nodes
UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'edge', NULL, count(*) FROM edges""")
def i05_save_and_load(spark, d):
    """The graph written, read again and counted."""
    path = _store(spark, "graph")
    I.save_graph(graph(spark, d), path)
    return I.load_graph(spark, path).stats()


@query("SELECT 'missing' AS what, 0 AS n UNION ALL SELECT 'demo', 3 + 3 + 2")
def s26_load_or_default(spark, d):
    """A graph that isn't there: empty, or the default given."""
    path = _store(spark, "nowhere")
    n = lambda kg, what: kg.edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(I.load_graph(spark, path), "missing").unionByName(n(I.load_graph(spark, path, default=I.demo_graph(spark, ["A", "B", "C"])), "demo"))


@query("""WITH g AS (SELECT g - 1 AS i FROM generate_series(1, 20) t(g))
SELECT 'gene:demo' || i AS source_id, 'disease:demo-' || (i % 4 + 1) AS target_id, 'gene_associated_with_disease' AS edge_type, round(0.65 + (i % 4) * 0.08, 6) AS score FROM g
UNION ALL SELECT 'gene:demo' || i, 'pathway:demo-' || (i % 4 + 1), 'gene_in_pathway', round(0.62 + (i % 3) * 0.1, 6) FROM g
UNION ALL SELECT 'gene:demo' || i, 'gene:demo' || (i + 1), 'gene_interacts_with_gene', round(0.58 + (i % 5) * 0.06, 6) FROM g WHERE i < 19""")
def s25_demo_graph(spark, d):
    """A demo graph of twenty made-up genes."""
    e = I.demo_graph(spark, [f"DEMO{i}" for i in range(20)]).edges
    return e.select("source_id", "target_id", "edge_type", F.round("score", 6).alias("score"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, round(list_sum(CAST(embedding AS DOUBLE[])) * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS total FROM embeddings")
def i18_put_vectors(spark, d):
    """A store of vectors in which every third is put anew, doubled; saved and loaded (I17, S27)."""
    v = _vectors(spark, d)
    path = _store(spark, "vectors")
    I.save_vectors(v, path)
    new = v.filter("cast(id as long) % 3 = 0").select("id", F.transform("vector", lambda x: x * 2).alias("vector"))
    return I.put_vectors(I.load_vectors(spark, path), new).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS n FROM embeddings")
def s27_load_vectors(spark, d):
    """A store of vectors written and read again."""
    path = _store(spark, "loaded")
    I.save_vectors(_vectors(spark, d), path)
    return I.load_vectors(spark, path).select("id", F.size("vector").cast("long").alias("n"))


@query("SELECT vector_id, doc_id, md5(text) AS digest FROM documents WHERE vector_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY created_at DESC, doc_id DESC) = 1")
def i13_vector_upsert(spark, d):
    """Documents upserted by vector id, with their text."""
    t = table(spark, d, "documents").select("vector_id", "doc_id", F.md5("text").alias("digest"), "created_at")
    return I.newest_vectors(t, F.struct("created_at", "doc_id")).select("vector_id", "doc_id", "digest")


@query("SELECT 'collection' AS what, 0 AS n UNION ALL SELECT 'cache', 0")
def i14_reset(spark, d):
    """A reset collection and a cleared cache (I16) hold nothing and keep their columns."""
    c = I.cleared(table(spark, d, "documents")).agg(F.count("doc_id").alias("n")).select(F.lit("collection").alias("what"), "n")
    return c.unionByName(I.cleared(_vectors(spark, d)).agg(F.count("vector").alias("n")).select(F.lit("cache").alias("what"), "n"))


@query("SELECT 'pmid:' || pmid AS id FROM pubmed_articles WHERE pmid IS NOT NULL GROUP BY pmid")
def i21_seed_corpus(spark, d):
    """A store that holds nothing seeded from the articles; one that holds something stays."""
    corpus = R.index_articles(table(spark, d, "pubmed_articles")).select("id", "text")
    first = I.seeded(spark.createDataFrame([], "id string, text string"), corpus)
    return I.seeded(first, corpus.limit(0)).select("id")


@query(GRAPH + "SELECT 'node' AS what, id, node_type AS type, NULL AS source_id, NULL AS target_id, NULL::DOUBLE AS score FROM nodes UNION ALL SELECT 'edge', NULL, edge_type, source_id, target_id, score FROM edges")
def q14_network(spark, d):
    """The full network as one listing."""
    from ..operators import reports as P

    return P.network(slim_graph(spark, d))


@query(GRAPH + """, f AS (SELECT DISTINCT id, 'Gene' AS node_type, name FROM nodes WHERE id IN (SELECT id FROM kg_nodes WHERE record_id % 50 = 0))
SELECT id AS doc, id, coalesce(name, id) AS name, 'Gene' AS node_type, 'llm_extraction' AS sources FROM f""")
def l17_extracted_entities(spark, d):
    """Entities of JSON answers in which types and sources are missing."""
    ids = node_records(spark, d).filter("record_id % 50 = 0").select("id").distinct()
    n = slim_graph(spark, d).nodes.join(ids, "id", "left_semi").select("id", "name")
    payload = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(F.struct("id", "name")).alias("entities"))), F.lit("\n```"))
    e = I.extracted_rows(n.select(F.col("id").alias("doc"), payload.alias("payload")))[0]
    return e.select("doc", "id", "name", "node_type", F.array_join("sources", "|").alias("sources"))


@query(GRAPH + """SELECT source_id, target_id, edge_type, CASE WHEN edge_type = 'drug_targets_gene' THEN 1.0 ELSE score END AS score FROM edges WHERE edge_type IN ('drug_targets_gene', 'drug_treats_disease')""")
def l17_extracted_relations(spark, d):
    """Relations of JSON answers, some without a score."""
    e = slim_graph(spark, d).of_type("drug_targets_gene", "drug_treats_disease")
    row = F.struct("source_id", "target_id", "edge_type", F.when(F.col("edge_type") != "drug_targets_gene", F.col("score")).alias("score"))
    rel = I.extracted_rows(e.select(F.col("source_id").alias("doc"), F.to_json(F.struct(F.array(row).alias("relations"))).alias("payload")))[1]
    return rel.select("source_id", "target_id", "edge_type", "score")


@query(GRAPH + """, g AS (SELECT DISTINCT name AS gene FROM kg_nodes WHERE record_id % 50 = 0 AND name IS NOT NULL UNION SELECT DISTINCT id FROM kg_nodes WHERE record_id % 50 = 1 AND id IS NOT NULL),
k AS (SELECT lower(trim(id)) AS k, 0 AS how, id FROM nodes WHERE node_type = 'Gene' UNION ALL SELECT lower(trim(name)), 1, id FROM nodes WHERE node_type = 'Gene' AND name IS NOT NULL),
b AS (SELECT k, id FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY how, id) = 1)
SELECT gene, id FROM g JOIN b ON b.k = lower(trim(g.gene))""")
def a13_gene_resolution(spark, d):
    """Genes by id, else by name."""
    r = table(spark, d, "kg_nodes")
    asked = r.filter("record_id % 50 = 0 and name is not null").select(F.col("name").alias("gene")).unionByName(r.filter("record_id % 50 = 1 and id is not null").select(F.col("id").alias("gene")))
    return A.resolve_genes(slim_graph(spark, d), asked)


@query("SELECT DISTINCT drug_id AS molecule_chembl_id, disease_id AS target_chembl_id, mechanism FROM drug_associations WHERE drug_id IS NOT NULL AND disease_id IS NOT NULL AND mechanism IS NOT NULL")
def s11_mechanism_reader(spark, d):
    """Mechanism responses, written from the table and read again."""
    a = table(spark, d, "drug_associations").filter("drug_id is not null and disease_id is not null and mechanism is not null").select("drug_id", "disease_id", "mechanism").distinct()
    row = F.struct(F.col("drug_id").alias("molecule_chembl_id"), F.col("disease_id").alias("target_chembl_id"), F.col("mechanism").alias("mechanism_of_action"))
    return S.mechanisms(a.select(F.to_json(F.struct(F.array(row).alias("mechanisms"))).alias("payload"))).select("molecule_chembl_id", "target_chembl_id", "mechanism")


@query(GRAPH + """, m AS (SELECT DISTINCT target_id AS list, source_id AS id FROM edges WHERE edge_type = 'drug_targets_gene'),
k AS (SELECT least(source_id, target_id) AS id_a, greatest(source_id, target_id) AS id_b, min(score) AS score FROM edges WHERE edge_type = 'drug_interacts_with_drug' AND source_id <> target_id GROUP BY ALL)
SELECT a.list, k.id_a, k.id_b, k.score FROM k JOIN m a ON a.id = k.id_a JOIN m b ON b.list = a.list AND b.id = k.id_b""")
def s17_known_interactions(spark, d):
    """Known interactions among the drugs of each target."""
    kg = slim_graph(spark, d)
    lists = kg.of_type("drug_targets_gene").select(F.col("target_id").alias("list"), F.col("source_id").alias("id"))
    known = kg.of_type("drug_interacts_with_drug").select(F.col("source_id").alias("id_a"), F.col("target_id").alias("id_b"), "score")
    return S.known_interactions(lists, known)


@query(GRAPH + """, s AS (SELECT source_id AS drug, target_id AS effect, row_number() OVER (PARTITION BY source_id ORDER BY target_id) - 1 AS pos FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'drug_causes_side_effect'))
SELECT drug, pos, effect FROM s WHERE pos < 5 UNION ALL SELECT id, 0, 'none' FROM nodes WHERE node_type = 'Drug' AND id NOT IN (SELECT drug FROM s)""")
def s20_drug_records(spark, d):
    """The first five records of each drug's response, a bundled one where there is none."""
    kg = slim_graph(spark, d)
    e = kg.of_type("drug_causes_side_effect").groupBy(F.col("source_id").alias("drug")).agg(F.array_sort(F.collect_set("target_id")).alias("x"))
    payload = F.to_json(F.struct(F.transform("x", lambda t: F.struct(t.alias("effect"))).alias("results")))
    bundled = kg.nodes.filter("node_type = 'Drug'").select(F.col("id").alias("drug"), F.lit(0).alias("pos"), F.lit('{"effect":"none"}').alias("record"))
    r = S.drug_records(e.select("drug", payload.alias("payload")), bundled, limit=5)
    return r.select("drug", F.col("pos").cast("long").alias("pos"), F.get_json_object("record", "$.effect").alias("effect"))


@query(GRAPH + """, l AS (SELECT target_id AS phenotype, source_id AS disease, score FROM edges WHERE edge_type = 'disease_has_phenotype' AND score >= 0.5), far AS (SELECT target_id AS phenotype, source_id AS disease, score FROM edges WHERE edge_type = 'disease_has_phenotype' AND score < 0.5)
SELECT * FROM l UNION ALL SELECT * FROM far WHERE phenotype NOT IN (SELECT phenotype FROM l)""")
def s22_phenotype_diseases(spark, d):
    """Diseases of phenotypes by a local list, else a remote one."""
    e = slim_graph(spark, d).of_type("disease_has_phenotype").select(F.col("target_id").alias("phenotype"), F.col("source_id").alias("disease"), "score")
    return S.phenotype_diseases(e, e.filter("score >= 0.5"), e.filter("score < 0.5"))
