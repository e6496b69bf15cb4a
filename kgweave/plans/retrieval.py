"""Queries over the corpus, and text rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..operators.runtime import table

_BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def _asked(spark, d):
    """Every article whose id is divisible by 50 asks with its title."""
    return table(spark, d, "pubmed_articles").filter("article_id % 50 = 0 and title is not null").select(F.col("article_id").alias("query"), F.col("title").alias("text"))


_TOK = "regexp_extract_all(lower({}), '[A-Za-z0-9_:-]+')"
_BM25 = f"""
WITH p AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_TOK.format("coalesce(text, '')")}) AS term FROM documents) GROUP BY ALL),
q AS (SELECT query, term, count(*) AS qf FROM (SELECT article_id AS query, unnest({_TOK.format('title')}) AS term FROM pubmed_articles WHERE article_id % 50 = 0 AND title IS NOT NULL) GROUP BY ALL),
len AS (SELECT doc, sum(tf) AS dl FROM p GROUP BY ALL), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len) AS words),
idf AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY ALL), n),
fl AS (SELECT 0.25 * avg(idf) AS f FROM idf),
s AS (SELECT query, doc, sum(qf * CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (words / n)))) AS score
  FROM p JOIN q USING (term) JOIN idf USING (term) JOIN len USING (doc), fl, n GROUP BY ALL),
k AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank, doc, score FROM s)
"""
_VEC = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS doc, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
k AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank, doc, score FROM s)
"""


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY ALL")
def r01_term_counts(spark, d):
    return R.postings(_docs(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(_BM25 + "SELECT query, rank, doc, round(score, 6) AS score FROM k WHERE rank <= 5")
def r02_bm25(spark, d):
    return R.bm25(_docs(spark, d), _asked(spark, d), top=5).withColumn("score", F.round("score", 6))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))


def _nearest(spark, d, top):
    v = _vectors(spark, d)
    q = v.filter("doc % 50 = 0").withColumnRenamed("doc", "query")
    return R.dense(v, q, top=top, exclude_self=True)


@query(_VEC + "SELECT query, rank, doc, round(score, 6) AS score FROM k WHERE rank <= 10")
def r04_dense_search(spark, d):
    return _nearest(spark, d, 10).withColumn("score", F.round("score", 6))


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT label, vec_id, e FROM v WHERE vec_id % 50 = 0)
SELECT v.vec_id, c.vec_id AS other, round(list_cosine_similarity(v.e, c.e), 6) AS score FROM v JOIN c ON c.label = v.label
""")
def r03_cosine(spark, d):
    v = table(spark, d, "embeddings")
    c = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("other"), "label", F.col("embedding").alias("e"))
    return v.join(c, "label").select("vec_id", "other", F.round(R.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@query(_BM25.replace("k AS (", "bk AS (") + "," + _VEC.strip()[len("WITH "):].replace("s AS (", "vs AS (").replace("FROM s)", "FROM vs)") + """
, b2 AS (SELECT query, doc, score / (1 + abs(score)) AS b FROM bk WHERE rank <= 10), d2 AS (SELECT query, doc, score / (1 + abs(score)) AS a FROM k WHERE rank <= 10),
h AS (SELECT query, doc, 0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0) AS score FROM d2 FULL JOIN b2 USING (query, doc))
SELECT query, rank, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM h) WHERE rank <= 5
""")
def r06_hybrid(spark, d):
    h = R.hybrid(_nearest(spark, d, 10), R.bm25(_docs(spark, d), _asked(spark, d), top=10), top=5)
    return h.withColumn("score", F.round("score", 6))


@query(_BM25.replace("k AS (", "bk AS (") + "," + _VEC.strip()[len("WITH "):].replace("s AS (", "vs AS (").replace("FROM s)", "FROM vs)") + """
SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query, doc, rank FROM bk WHERE rank <= 15 UNION ALL SELECT query, doc, rank FROM k WHERE rank <= 15) GROUP BY ALL
""")
def r08_rank_fusion(spark, d):
    f = R.fuse(R.bm25(_docs(spark, d), _asked(spark, d), top=15), _nearest(spark, d, 15))
    return f.withColumn("score", F.round("score", 9))


@query(_BM25 + f""", h AS (SELECT k.query, k.doc, k.score, {_TOK.format('a.title')} AS q, {_TOK.format("coalesce(t.metadata['title'], '')")} AS ti,
  {_TOK.format("concat_ws(chr(10), nullif(t.metadata['title'], ''), nullif(t.text, ''))")} AS al, t.source FROM k JOIN pubmed_articles a ON a.article_id = k.query JOIN documents t ON t.doc_id = k.doc WHERE rank <= 15),
f AS (SELECT query, doc, score + len(list_intersect(list_distinct(q), list_distinct(al))) / len(list_distinct(q)) + CASE WHEN list_has_any(q, ti) THEN 0.15 ELSE 0 END AS score FROM h)
SELECT query, rank, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM f) WHERE rank <= 5
""")
def r12_rerank(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "source", F.try_element_at("metadata", F.lit("title")).alias("title"))
    hits = R.bm25(_docs(spark, d), _asked(spark, d), top=15).drop("rank").join(t, "doc").join(_asked(spark, d).withColumnRenamed("text", "query_text"), "query").withColumn("context", F.lit(""))
    return R.rerank(hits, top=5).withColumn("score", F.round("score", 6))


@query("""
WITH r AS (SELECT article_id, authors, year FROM pubmed_articles),
k AS (SELECT article_id, coalesce(CASE WHEN len(authors) > 0 THEN nullif(trim(split_part(trim(authors[1]), ' ', 1), ','), '') END, 'Unknown') || CASE WHEN len(authors) > 1 THEN ' et al., ' ELSE ', ' END || coalesce(CAST(year AS VARCHAR), 'n.d.') AS key FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY article_id) AS n FROM k)
SELECT article_id, key || CASE WHEN n = 1 THEN '' WHEN n <= 27 THEN chr(CAST(95 + n AS INTEGER)) ELSE CAST(n AS VARCHAR) END AS citation FROM n
""")
def r17_citation_keys(spark, d):
    a = table(spark, d, "pubmed_articles").select("article_id", X.inline_citation(F.col("authors"), F.col("year")).alias("key"))
    n = a.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("article_id")))
    suffix = F.when(F.col("n") == 1, "").when(F.col("n") <= 27, F.chr(F.col("n") + 95)).otherwise(F.col("n").cast("string"))
    return n.select("article_id", F.concat("key", suffix).alias("citation"))


_CITED = r"list_distinct(regexp_extract_all(text, '\[(?:PMID:)?(\d+)\]', 1))"


@query(rf"SELECT doc_id, array_to_string(list_sort({_CITED}), '|') AS pmids, CAST(len({_CITED}) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND len({_CITED}) > 0")
def r19_cited_pmids(spark, d):
    c = table(spark, d, "documents").filter("text is not null").select("doc_id", X.cited_pmids(F.col("text")).alias("c")).filter(F.size("c") > 0)
    return c.select("doc_id", F.array_join(F.array_sort("c"), "|").alias("pmids"), F.size("c").cast("long").alias("n"))


@query(r"""
WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\[(?:PMID:)?(\d+)\]', 1)) AS pmid FROM documents)
SELECT doc_id, pmid FROM c WHERE pmid NOT IN (SELECT pmid FROM pubmed_articles WHERE pmid IS NOT NULL)
""")
def r18_invalid_citations(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(X.cited_pmids(F.col("text"))).alias("pmid"))
    return c.join(table(spark, d, "pubmed_articles").select("pmid"), "pmid", "left_anti").select("doc_id", "pmid")


@query("""
SELECT 'pmid:' || pmid AS id, md5(text) AS digest, year FROM (SELECT pmid, year, concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(abstract), '')) AS text FROM pubmed_articles
  WHERE pmid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY article_id) = 1)
""")
def i11_index_articles(spark, d):
    return R.index_articles(table(spark, d, "pubmed_articles")).select("id", F.md5("text").alias("digest"), "year")


@query("""
SELECT coalesce(CAST(year AS VARCHAR), 'unknown') AS year, count(*) AS n FROM (SELECT pmid, year FROM pubmed_articles
  WHERE pmid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY article_id) = 1) GROUP BY ALL
""")
def i12_index_stats(spark, d):
    return R.index_articles(table(spark, d, "pubmed_articles")).groupBy(F.coalesce(F.col("year").cast("string"), F.lit("unknown")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT sha256('m' || chr(0) || text) AS cache_key FROM documents WHERE text IS NOT NULL
AND text NOT IN (SELECT abstract FROM pubmed_articles WHERE abstract IS NOT NULL)""")
def i15_cache_misses(spark, d):
    """Texts of documents that aren't cached as abstracts."""
    cache = table(spark, d, "pubmed_articles").filter("abstract is not null").select(F.sha2(F.concat(F.lit("m"), F.lit("\0"), "abstract"), 256).alias("cache_key"))
    return R.cache_misses(table(spark, d, "documents").select("text"), cache, "m").select("cache_key")


def _rule(words, col):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("SELECT level, score, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {_rule(w, 't')} THEN '{lv}'" for w, lv, _ in X.EVIDENCE) + f" ELSE '{X.EVIDENCE_ELSE[0]}' END AS level, CASE "
       + " ".join(f"WHEN {_rule(w, 't')} THEN CAST({s} AS DOUBLE)" for w, _, s in X.EVIDENCE) + f" ELSE CAST({X.EVIDENCE_ELSE[1]} AS DOUBLE) END AS score FROM (SELECT lower(text) AS t FROM documents WHERE text IS NOT NULL)) GROUP BY ALL")
def c12_evidence_levels(spark, d):
    e = table(spark, d, "documents").filter("text is not null").select(X.evidence_level(F.col("text")).alias("e"))
    return e.groupBy("e.level", "e.score").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {_rule(w, 'lower(text)')} THEN '{s}'" for w, s in X.SEVERITY_WORDS) + " ELSE 'minor' END AS severity FROM documents WHERE text IS NOT NULL")
def s19_severity(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", X.infer_severity(F.col("text")).alias("severity"))


def _classify_sql(col):
    weights = {k: " + ".join("CASE WHEN regexp_matches(" + col + ", '\\b" + w.replace(" ", "\\s+") + "\\b') THEN " + str(len(w.split())) + " ELSE 0 END" for w in ws) for k, ws in X.KEYWORDS.items()}
    best = "greatest(" + ", ".join(weights.values()) + ")"
    return "CASE WHEN " + _rule(X.COMPLEX, col) + f" THEN 'router' WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {w} = {best} THEN '{k}'" for k, w in weights.items()) + " END"


@query(f"SELECT doc_id, {_classify_sql('t')} AS task FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)")
def o01_classify(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", X.classify_task(F.col("text")).alias("task"))


_VERBED = "(?:" + X.CLAUSE_VERBS + r")\b"


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[;?]\s*', chr(1), 'g'), '(?i),\s*({_VERBED})', chr(1) || '\1', 'g'), '(?i)\band\b(\s+{_VERBED})', chr(1) || '\1', 'g') AS t FROM t),
p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^[ ,.]+|[ ,.]+$', '', 'g')), lambda x: x <> '') AS p FROM c)
SELECT doc_id, pos, md5(x) AS digest, length(x) AS n FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS pos FROM p)""")
def o05_clauses(spark, d):
    c = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(X.split_clauses(F.col("text"))).alias("pos", "clause"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("clause").alias("digest"), F.length("clause").cast("long").alias("n"))


@query("SELECT doc_id, i AS pos, md5(substr(text, CAST(i * 180 + 1 AS BIGINT), 180)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 180)) AS i FROM documents WHERE length(text) > 0)")
def o22_chunks(spark, d):
    c = table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", F.posexplode(X.chunk(F.col("text"))).alias("pos", "piece"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("piece").alias("digest"))




@query(rf"""SELECT doc_id, CAST(least(10.0, 5.0 + CASE WHEN len(list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '')) >= 80 THEN 2.0 ELSE 0 END
 + CASE WHEN len(list_distinct(regexp_extract_all(text, '\[(?:PMID:)?(\d+)\]', 1))) >= 2 THEN 2.5 ELSE 0 END + CASE WHEN NOT contains(lower(text), 'insufficient evidence') THEN 0.5 ELSE 0 END) AS DOUBLE) AS score FROM documents WHERE text IS NOT NULL""")
def o12_critique(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", X.critique(F.col("text")).alias("score"))


@query(r"""SELECT article_id, array_to_string(CASE WHEN len(q) > 0 THEN list_concat([title], q)[1:3] WHEN len(w) > 0 THEN [title, array_to_string(w[1:5], ' ')] ELSE [title] END, '|') AS queries
FROM (SELECT article_id, title, regexp_extract_all(title, '"([^"]+)"', 1) AS q, regexp_extract_all(title, '[A-Za-z0-9_-]{4,}') AS w FROM pubmed_articles WHERE title IS NOT NULL)""")
def r22_fallback_queries(spark, d):
    return table(spark, d, "pubmed_articles").filter("title is not null").select("article_id", F.array_join(X.fallback_queries(F.col("title")), "|").alias("queries"))


_STRIPPED = rf"regexp_replace(abstract, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@query(rf"SELECT article_id, coalesce(nullif(regexp_extract({_STRIPPED}, '^((?s:.*?)[.!?])\s', 1), ''), {_STRIPPED}) AS sentence FROM pubmed_articles WHERE abstract IS NOT NULL")
def r23_first_sentences(spark, d):
    return table(spark, d, "pubmed_articles").filter("abstract is not null").select("article_id", X.first_sentence(F.col("abstract")).alias("sentence"))


@query("SELECT term_id, 'x:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (SELECT DISTINCT term_id, name FROM vocab_terms)")
def l15_slugs(spark, d):
    return table(spark, d, "vocab_terms").select("term_id", "name").distinct().select("term_id", X.slug("x", F.col("name")).alias("slug"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def l16_lenient_json(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(X.lenient_json(F.concat(F.lit("payload: "), "props", F.lit(" end"))), "$.k", "bigint").alias("k"))
