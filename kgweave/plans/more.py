"""Further queries: readers of raw responses, lookups, evidence, context and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import graph as G
from ..operators import learning as L
from ..operators import retrieval as R
from ..operators.runtime import table
from ..sources import readers as S
from .graph import TOPIC
from .testbed import GRAPH, slim_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


def _nest(*path, value):
    """A JSON payload with a value under nested keys."""
    for p in reversed(path):
        value = F.struct(value.alias(p))
    return F.to_json(value).alias("payload")


# --- readers: responses written from the tables and read again ---------------------------------------------------------


@query("""SELECT article_id, pmid, md5(coalesce(title, '')) AS title, md5(coalesce(abstract, '')) AS abstract, year, coalesce(array_to_string(authors, '|'), '') AS authors, coalesce(doi, '') AS doi
FROM (SELECT article_id, pmid, trim(regexp_replace(title, '[\\x00-\\x1f]+', ' ', 'g')) AS title, trim(regexp_replace(abstract, '[\\x00-\\x1f]+', ' ', 'g')) AS abstract, year, authors, doi FROM pubmed_articles WHERE pmid IS NOT NULL)""")
def s03_article_xml(spark, d):
    """Articles as XML, read again; the article's own id travels as a keyword."""
    a = table(spark, d, "pubmed_articles").filter("pmid is not null")
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x1f]+", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))
    people = F.array_join(F.transform("authors", lambda x: F.concat(F.lit("<Author><CollectiveName>"), safe(x), F.lit("</CollectiveName></Author>"))), "")
    article = F.concat(tag("ArticleTitle", safe(F.col("title"))), tag("Abstract", tag("AbstractText", safe(F.col("abstract")))), tag("Journal", tag("JournalIssue", tag("PubDate", tag("Year", F.col("year").cast("string"))))), tag("AuthorList", people))
    cite = tag("MedlineCitation", F.concat(tag("PMID", F.col("pmid")), tag("Article", article), tag("KeywordList", tag("Keyword", F.col("article_id").cast("string")))))
    ids = F.coalesce(F.concat(F.lit('<PubmedData><ArticleIdList><ArticleId IdType="doi">'), safe(F.col("doi")), F.lit("</ArticleId></ArticleIdList></PubmedData>")), F.lit(""))
    out = S.pubmed_articles(a.select(tag("PubmedArticleSet", tag("PubmedArticle", F.concat(cite, ids))).alias("payload")))
    digest = lambda c: F.md5(F.coalesce(F.trim(c), F.lit("")))
    return out.select(F.col("keywords")[0].cast("long").alias("article_id"), "pmid", digest("title").alias("title"), digest("abstract").alias("abstract"), "year", F.coalesce(F.array_join("authors", "|"), F.lit("")).alias("authors"), F.coalesce("doi", F.lit("")).alias("doi"))


@query("SELECT DISTINCT ensembl_id, symbol, name, biotype, description FROM gene_info WHERE ensembl_id IS NOT NULL")
def s05_gene_reader(spark, d):
    g = table(spark, d, "gene_info").filter("ensembl_id is not null").distinct()
    t = F.struct(F.col("ensembl_id").alias("id"), F.col("symbol").alias("approvedSymbol"), F.col("name").alias("approvedName"), "biotype", F.array_compact(F.array("description")).alias("functionDescriptions"))
    return S.gene_info(g.select(_nest("data", "target", value=t)))


@query("SELECT DISTINCT disease_id, drug_id, drug_name, phase, status, mechanism FROM drug_associations")
def s07_disease_drug_reader(spark, d):
    a = table(spark, d, "drug_associations").select("disease_id", "drug_id", "drug_name", "phase", "status", "mechanism").distinct()
    row = F.struct(F.struct(F.col("drug_id").alias("id"), F.col("drug_name").alias("name")).alias("drug"), F.col("phase").cast("double").alias("phase"), "status", F.col("mechanism").alias("mechanismOfAction"))
    return S.disease_drugs(a.select(_nest("data", "disease", value=F.struct(F.col("disease_id").alias("id"), F.struct(F.array(row).alias("rows")).alias("knownDrugs")))))


@query("SELECT DISTINCT chembl_id, name, max_phase, molecule_type FROM chembl_drugs WHERE chembl_id IS NOT NULL")
def s09_molecule_reader(spark, d):
    m = table(spark, d, "chembl_drugs").filter("chembl_id is not null").select("chembl_id", "name", "max_phase", "molecule_type").distinct()
    return S.molecules(m.select(F.to_json(F.struct(F.col("chembl_id").alias("molecule_chembl_id"), F.col("name").alias("pref_name"), F.col("max_phase").cast("string").alias("max_phase"), "molecule_type")).alias("payload")))


@query("SELECT DISTINCT assay_chembl_id, activity_type, activity_value, units FROM bioactivities WHERE activity_value IS NOT NULL AND NOT isnan(activity_value)")
def s12_activity_reader(spark, d):
    a = table(spark, d, "bioactivities").filter("activity_value is not null and not isnan(activity_value)").select("assay_chembl_id", "activity_type", "activity_value", "units").distinct()
    row = F.struct("assay_chembl_id", F.col("activity_type").alias("standard_type"), F.col("activity_value").cast("string").alias("standard_value"), F.col("units").alias("standard_units"))
    return S.activities(a.select(_nest("activities", value=F.array(row))))


@query("SELECT DISTINCT accession, protein_name, array_to_string(gene_names, '|') AS gene_names, organism, length FROM uniprot_proteins")
def s13_protein_reader(spark, d):
    p = table(spark, d, "uniprot_proteins").distinct()
    wrap = lambda c, *names: c if not names else F.struct(wrap(c, *names[1:]).alias(names[0]))
    row = F.struct(F.col("accession").alias("primaryAccession"), wrap(F.col("protein_name"), "recommendedName", "fullName", "value").alias("proteinDescription"), F.transform("gene_names", lambda g: F.struct(F.struct(g.alias("value")).alias("geneName"))).alias("genes"), F.struct(F.col("organism").alias("scientificName")).alias("organism"), F.struct("length").alias("sequence"))
    out = S.proteins(p.select(_nest("results", value=F.array(row))))
    return out.withColumn("gene_names", F.array_join("gene_names", "|"))


@query("""WITH t AS (SELECT * FROM (VALUES ('mr'), ('imaging'), ('syndrome')) t(term)),
s AS (SELECT article_id, count(*) AS score FROM pubmed_articles, t WHERE contains(lower(concat_ws(' ', title, abstract)), term) GROUP BY ALL)
SELECT article_id, score FROM s ORDER BY score DESC, article_id DESC LIMIT 20""")
def s24_article_scan(spark, d):
    """Articles by how many of a query's distinct words occur in them as substrings, the best twenty."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    score = sum((text.contains(w).cast("long") for w in ("mr", "imaging", "syndrome")), F.lit(0).cast("long"))
    return table(spark, d, "pubmed_articles").select("article_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), F.desc("article_id")).limit(20)


# --- lookups and relational ----------------------------------------------------------------------------------------------


@query(GRAPH + "SELECT id, name, node_type FROM nodes WHERE id = 'gene:x005eg'")
def l01_get_node(spark, d):
    return slim_graph(spark, d).get_node("gene:x005eg").select("id", "name", "node_type")


@query(f"SELECT article_id FROM pubmed_articles WHERE contains(lower(coalesce(title, '')), '{TOPIC}') OR contains(lower(coalesce(abstract, '')), '{TOPIC}')")
def a16_topic_articles(spark, d):
    t = F.lower(F.coalesce("title", F.lit(""))).contains(TOPIC) | F.lower(F.coalesce("abstract", F.lit(""))).contains(TOPIC)
    return table(spark, d, "pubmed_articles").filter(t).select("article_id")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS doc, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND b.label = 1)
SELECT query, rank, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM s) WHERE rank <= 5""")
def a15_typed_neighbours(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")
    near = R.dense(v.filter("label = 1"), v.filter("doc % 50 = 0").select(F.col("doc").alias("query"), "vector"), top=5, exclude_self=True)
    return near.withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT term_id AS k, kind, length(name) / 1000.0::DOUBLE AS p FROM (SELECT DISTINCT term_id, kind, name FROM vocab_terms)), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p, k) AS rk, count(*) OVER (PARTITION BY kind) AS m FROM p)
SELECT k, round(least(1.0, min(p * m / rk) OVER (PARTITION BY kind ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS fdr FROM r""")
def a12_benjamini_hochberg(spark, d):
    p = table(spark, d, "vocab_terms").select(F.col("term_id").alias("k"), "kind", "name").distinct().withColumn("p", F.length("name") / F.lit(1000.0))
    return A.benjamini_hochberg(p, ["kind"], "p", ["k"]).select("k", F.round("fdr", 9).alias("fdr"))


# --- context, reports --------------------------------------------------------------------------------------------------


@query(GRAPH + """, s AS (SELECT DISTINCT id FROM kg_nodes WHERE record_id % 50 = 0 AND node_type IN ('Gene', 'Disease')),
t AS (SELECT e.source_id, e.target_id, e.edge_type, e.score, coalesce(a.name, a.id) || ' ' || e.edge_type || ' ' || coalesce(b.name, b.id) AS triple FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.source_id IN (SELECT id FROM s) AND e.target_id IN (SELECT id FROM s))
SELECT row_number() OVER (ORDER BY score DESC, source_id, target_id, edge_type) AS rank, triple, score FROM t ORDER BY rank LIMIT 50""")
def r15_context_triples(spark, d):
    s = table(spark, d, "kg_nodes").filter("record_id % 50 = 0 and node_type in ('Gene', 'Disease')").select("id").distinct()
    return slim_graph(spark, d).triples(s, limit=50)


@query(r"""SELECT article_id, '- [' || coalesce(CASE WHEN len(authors) > 0 THEN nullif(trim(split_part(trim(authors[1]), ' ', 1), ','), '') END, 'Unknown') || CASE WHEN len(authors) > 1 THEN ' et al., ' ELSE ', ' END || coalesce(CAST(year AS VARCHAR), 'n.d.') || '] '
 || CASE WHEN len(authors) > 0 THEN array_to_string(authors, ', ') ELSE 'Unknown author' END || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '). ' || coalesce(title, '') || '. *' || coalesce(journal, 'Unknown journal') || '*. PMID: ' || pmid || '.' || CASE WHEN coalesce(doi, '') <> '' THEN ' DOI: ' || doi || '.' ELSE '' END AS line FROM pubmed_articles WHERE pmid IS NOT NULL""")
def r20_bibliography(spark, d):
    a = table(spark, d, "pubmed_articles").filter("pmid is not null")
    people = F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise("Unknown author")
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    doi = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit(" DOI: "), "doi", F.lit("."))).otherwise("")
    line = F.concat(F.lit("- ["), X.inline_citation(F.col("authors"), F.col("year")), F.lit("] "), people, F.lit(" ("), year, F.lit("). "), F.coalesce("title", F.lit("")), F.lit(". *"), F.coalesce("journal", F.lit("Unknown journal")), F.lit("*. PMID: "), "pmid", F.lit("."), doi)
    return a.select("article_id", line.alias("line"))


@query(GRAPH + "SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE edge_type = 'drug_treats_disease'")
def m03_positives(spark, d):
    return slim_graph(spark, d).of_type("drug_treats_disease").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()


@query(GRAPH + """, b AS (SELECT DISTINCT source_id AS id, target_id AS other FROM edges WHERE source_id <> target_id UNION SELECT DISTINCT target_id, source_id FROM edges WHERE source_id <> target_id)
SELECT id, count(*) AS n, min(other) AS first, max(other) AS last FROM b GROUP BY ALL""")
def m17_neighbours(spark, d):
    return slim_graph(spark, d).neighbour_pairs().groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first"), F.max("other").alias("last"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT CAST(a.vec_id AS VARCHAR) AS src, CAST(b.vec_id AS VARCHAR) AS dst, round(1 / (1 + exp(-list_cosine_similarity(a.e, b.e))), 8) AS score FROM v a JOIN v b ON b.label = a.label WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id""")
def m09_link_scores(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", "vec_id", F.col("embedding").alias("x"))
    a, b = (v.select(F.col("id").alias(n), "label", F.col("vec_id").alias("k" + n)) for n in ("src", "dst"))
    pairs = a.filter("ksrc % 50 = 0").join(b, "label").filter("ksrc <> kdst").select("src", "dst")
    return L.link_scores(pairs, v.select("id", "x")).withColumn("score", F.round("score", 8))


@query("""WITH c AS (SELECT hypothesis_id, score, len(literature_support) AS n FROM (SELECT DISTINCT hypothesis_id, score, literature_support FROM hypotheses))
SELECT hypothesis_id, round(CASE WHEN n = 0 THEN 0.1 ELSE greatest(0, least(0.95, 0.55 + 0.35 * least(n / 5.0, 1.0))) END, 9) AS confidence FROM c WHERE n IS NOT NULL""")
def o12_literature_confidence(spark, d):
    h = table(spark, d, "hypotheses").select("hypothesis_id", "score", "literature_support").distinct().filter("literature_support is not null")
    return h.select("hypothesis_id", F.round(X.literature_confidence(F.size("literature_support"), F.lit(0)), 9).alias("confidence"))


@query("""SELECT hypothesis_id, round(0.7 * score + 0.3 * least(coalesce(len(literature_support), 0), 3) / 3.0, 9) AS strength FROM (SELECT DISTINCT hypothesis_id, score, literature_support FROM hypotheses) WHERE score IS NOT NULL AND NOT isnan(score)""")
def o20_hypothesis_strength(spark, d):
    h = table(spark, d, "hypotheses").select("hypothesis_id", "score", "literature_support").distinct().filter("score is not null and not isnan(score)")
    return h.select("hypothesis_id", F.round(0.7 * F.col("score") + 0.3 * F.least(F.greatest(F.coalesce(F.size("literature_support"), F.lit(0)), F.lit(0)), F.lit(3)) / 3.0, 9).alias("strength"))


