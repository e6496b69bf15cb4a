"""Queries of the clinical rules, lookups in text and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clinical as C
from ..operators.runtime import table
from ..sources import readers as S
from .testbed import GRAPH, slim_graph

_BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = "regexp_replace({}, '^" + _BLANK.replace("{", "{{").replace("}", "}}") + "+|" + _BLANK.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


def _vocabulary(spark, d, kind):
    return table(spark, d, "vocab_terms").filter(F.col("kind") == kind).distinct()


@query("""
WITH v AS (SELECT DISTINCT term_id, name, synonyms FROM vocab_terms WHERE kind = 'drug'), k AS (SELECT term_id, name, 0 AS how, lower(name) AS key FROM v UNION ALL SELECT term_id, name, 1, lower(unnest(synonyms)) FROM v),
b AS (SELECT key, term_id, name FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY how, term_id) = 1),
n AS (SELECT DISTINCT x AS name FROM (SELECT unnest(drugs) AS x FROM clinical_intake) WHERE x IS NOT NULL)
SELECT n.name, coalesce(b.term_id, '') AS id FROM n LEFT JOIN b ON b.key = lower(""" + _STRIP.format("n.name") + """)
""")
def s15_normalise_drugs(spark, d):
    v = _vocabulary(spark, d, "drug").select(F.col("term_id").alias("id"), F.col("name").alias("label"), "synonyms")
    names = table(spark, d, "clinical_intake").select(F.explode("drugs").alias("name")).filter("name is not null")
    return C.normalise_names(names, v).select("name", "id")


@query(GRAPH + """, rr AS (SELECT source_id AS a, target_id AS b, CASE WHEN score >= 0.9 THEN 'severe' WHEN score >= 0.5 THEN 'monitor' ELSE 'minor' END AS s, source_id || target_id AS seq FROM edges WHERE edge_type = 'drug_interacts_with_drug' AND source_id <> target_id AND trim(source_id) <> '' AND trim(target_id) <> ''),
p AS (SELECT least(a, b) AS drug_a, greatest(a, b) AS drug_b, s FROM rr QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq) = 1),
x AS (SELECT DISTINCT source_id AS drug, lower(target_id) AS reaction FROM edges WHERE edge_type = 'drug_causes_side_effect'),
e AS (SELECT p.*, EXISTS (SELECT 1 FROM x a JOIN x b USING (reaction) WHERE a.drug = p.drug_a AND b.drug = p.drug_b) AS escalated, CASE s WHEN 'severe' THEN 3 WHEN 'monitor' THEN 2 ELSE 1 END AS lv FROM p),
f AS (SELECT drug_a, drug_b, escalated, least(4, lv + CASE WHEN escalated THEN 1 ELSE 0 END) AS lv FROM e)
SELECT drug_a, drug_b, ['minor', 'moderate', 'major', 'contraindicated'][lv] AS severity, escalated,
 ['""" + "', '".join(X.ADVICE[s] for s in X.SEVERITIES) + """'][lv] AS advice FROM f""")
def c01_interactions(spark, d):
    kg = slim_graph(spark, d)
    severity = F.when(F.col("score") >= 0.9, "severe").when(F.col("score") >= 0.5, "monitor").otherwise("minor")
    r = kg.of_type("drug_interacts_with_drug").select(F.concat("source_id", "target_id").alias("seq"), F.col("source_id").alias("drug_a"), F.col("target_id").alias("drug_b"), severity.alias("severity"))
    x = kg.of_type("drug_causes_side_effect").select(F.col("source_id").alias("drug"), F.col("target_id").alias("reaction"))
    return C.interactions(r, reactions=x)


@query("""
WITH c AS (SELECT DISTINCT name AS condition FROM vocab_terms WHERE kind = 'disease')
SELECT DISTINCT doc_id AS label, condition FROM documents, c WHERE contains(lower(text), lower(condition))
""")
def c04_contraindications(spark, d):
    c = _vocabulary(spark, d, "disease").select(F.col("name").alias("condition"))
    return C.contraindications(table(spark, d, "documents").select(F.col("doc_id").alias("label"), "text"), c)


@query(r"SELECT DISTINCT request_id, pos, finding FROM (SELECT request_id, unnest(p) AS finding, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT request_id, list_filter(list_transform(regexp_split_to_array(input_term, ',|;|\n|\band\b'), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '') AS p FROM clinical_intake WHERE input_term IS NOT NULL))")
def c05_findings(spark, d):
    return table(spark, d, "clinical_intake").filter("input_term is not null").select("request_id", F.posexplode(X.split_findings(F.col("input_term"))).alias("pos", "finding")).withColumn("pos", F.col("pos").cast("long")).distinct()


_TERMS = """
WITH t AS (SELECT DISTINCT term_id, lower(name) AS n, coalesce(list_transform(synonyms, lambda s: lower(s)), []) AS s FROM vocab_terms WHERE kind = 'phenotype'),
q AS (SELECT * FROM (SELECT DISTINCT input_term AS query, lower(""" + _STRIP.format("input_term") + """) AS q FROM clinical_intake) WHERE q <> ''),
h AS (SELECT query, term_id, CAST(CASE WHEN q = n THEN 2 ELSE 0 END + CASE WHEN contains(n, q) THEN 1 ELSE 0 END + CASE WHEN len(list_filter(s, lambda x: contains(x, q) OR contains(q, x))) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM q, t),
k AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, term_id) AS rank, term_id, score FROM h WHERE score > 0)
"""


def _searched(spark, d, top):
    q = table(spark, d, "clinical_intake").select(F.col("input_term").alias("query"))
    return C.search_terms(q, _vocabulary(spark, d, "phenotype"), top=top)


@query(_TERMS + "SELECT * FROM k WHERE rank <= 10")
def s21_term_search(spark, d):
    return _searched(spark, d, 10)


@query(_TERMS + """SELECT request_id, term_id FROM (SELECT DISTINCT request_id, input_term FROM clinical_intake) c JOIN k ON k.query = c.input_term WHERE rank <= 3""")
def c06_map_to_terms(spark, d):
    r = table(spark, d, "clinical_intake").select("request_id", F.col("input_term").alias("query")).distinct()
    return r.join(_searched(spark, d, 3), "query").select("request_id", "term_id")


_CASES = GRAPH + """, m AS (SELECT DISTINCT source_id AS "case", target_id AS phenotype, score FROM edges WHERE edge_type = 'gene_associated_with_phenotype'),
a AS (SELECT source_id AS disease, target_id AS phenotype, score AS s2 FROM edges WHERE edge_type = 'disease_has_phenotype'),
s AS (SELECT "case", disease, sum(score * s2) AS score FROM m JOIN a USING (phenotype) GROUP BY ALL)
"""


def _matches(kg):
    return kg.of_type("gene_associated_with_phenotype").select(F.col("source_id").alias("case"), F.col("target_id").alias("phenotype"), "score")


@query(_CASES + """SELECT "case", rank, disease, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY round(score, 9) DESC, disease) AS rank FROM s) WHERE rank <= 10""")
def c07_rank_diseases(spark, d):
    kg = slim_graph(spark, d)
    a = kg.of_type("disease_has_phenotype").select(F.col("target_id").alias("phenotype"), F.col("source_id").alias("disease"), "score")
    return C.rank_diseases(_matches(kg), a).withColumn("score", F.round("score", 6))


@query(_CASES + """, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY round(score, 9) DESC, disease) AS rank FROM s) WHERE rank <= 20),
g AS (SELECT "case", disease, count(*) AS n FROM (SELECT DISTINCT "case", phenotype FROM m) JOIN (SELECT DISTINCT disease, phenotype FROM a) USING (phenotype) GROUP BY ALL),
l AS (SELECT target_id AS disease, count(*) AS papers FROM edges WHERE edge_type = 'publication_mentions_disease' GROUP BY ALL),
f AS (SELECT k."case", k.disease, 0.55 * score + 0.25 * least(coalesce(n, 0), 5) / 5.0 + 0.20 * least(coalesce(papers, 0), 5) / 5.0 AS score FROM k LEFT JOIN g ON g."case" = k."case" AND g.disease = k.disease LEFT JOIN l ON l.disease = k.disease)
SELECT "case", rank, disease, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY round(score, 9) DESC, disease) AS rank FROM f) WHERE rank <= 10""")
def c09_differential(spark, d):
    kg = slim_graph(spark, d)
    return C.differential(kg, _matches(kg)).withColumn("score", F.round("score", 6))


@query(GRAPH + "SELECT target_id AS disease, count(*) AS papers FROM edges WHERE edge_type = 'publication_mentions_disease' GROUP BY ALL")
def c11_literature_support(spark, d):
    return C.literature_support(slim_graph(spark, d))


@query("SELECT user_id, rank, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 3")
def c13_top_reactions(spark, d):
    return C.top_values(table(spark, d, "events"), "user_id", "event_type", top=3)


@query("""WITH k AS (SELECT DISTINCT article_id, list_distinct(keywords) AS a, list_distinct(mesh_terms) AS b FROM pubmed_articles)
SELECT article_id, round(CASE WHEN coalesce(len(a), 0) > 0 AND coalesce(len(b), 0) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 9) AS similarity FROM k""")
def s23_set_similarity(spark, d):
    a = table(spark, d, "pubmed_articles").select("article_id", "keywords", "mesh_terms")
    return a.select("article_id", F.round(C.set_similarity(F.col("keywords"), F.col("mesh_terms")), 9).alias("similarity"))


@query("SELECT DISTINCT ensembl_id, disease_id, disease_name, score, CAST(0 AS INTEGER) AS evidence_count FROM disease_associations WHERE score IS NOT NULL AND NOT isnan(score)")
def s06_association_reader(spark, d):
    """Association responses, written from the table and read again."""
    a = table(spark, d, "disease_associations").filter("score is not null and not isnan(score)").select("ensembl_id", "disease_id", "disease_name", "score").distinct()
    row = F.struct(F.struct(F.col("disease_id").alias("id"), F.col("disease_name").alias("name")).alias("disease"), "score", F.array().cast("array<struct<id:string,score:double>>").alias("datasourceScores"))
    payload = F.to_json(F.struct(F.struct(F.struct(F.col("ensembl_id").alias("id"), F.struct(F.array(row).alias("rows")).alias("associatedDiseases")).alias("target")).alias("data")))
    return S.gene_diseases(a.select(payload.alias("payload")))


@query("SELECT molecule_chembl_id, activity_id FROM (SELECT DISTINCT molecule_chembl_id, activity_id FROM bioactivities) QUALIFY row_number() OVER (PARTITION BY molecule_chembl_id ORDER BY activity_id) = 1")
def s10_first_molecules(spark, d):
    return S.first_molecules(table(spark, d, "bioactivities").select("molecule_chembl_id", "activity_id"), seq="activity_id").select("molecule_chembl_id", "activity_id")


