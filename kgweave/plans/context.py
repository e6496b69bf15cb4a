"""Queries of graph context, retrieval with it, verification, answers and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context as K
from ..operators import retrieval as R
from ..operators.runtime import checkpoint, table
from .retrieval import _TOK
from .testbed import GRAPH, HAY, graph, slim_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return put


# --- inputs, and the pieces of SQL that say the same -----------------------------------------------------------------------


def _titles(spark, d):
    """Every article whose id is divisible by 50 asks with its title."""
    return table(spark, d, "pubmed_articles").filter("article_id % 50 = 0 and title is not null").select(F.col("article_id").alias("query"), F.col("title").alias("text"))


_TITLES = "ask AS MATERIALIZED (SELECT article_id AS query, title AS text FROM pubmed_articles WHERE article_id % 50 = 0 AND title IS NOT NULL)"


def _questions(spark, d):
    """Every hypothesis whose id is divisible by 50 asks about its ends by name."""
    kg = slim_graph(spark, d)
    n = kg.nodes.filter("name is not null").select("id", "name")
    h = table(spark, d, "hypotheses").filter("hypothesis_id % 50 = 0").select("hypothesis_id", "source_id", "target_id").distinct()
    h = h.join(n.withColumnsRenamed({"id": "source_id", "name": "s"}), "source_id").join(n.withColumnsRenamed({"id": "target_id", "name": "t"}), "target_id")
    text = F.concat(F.lit("What links "), "s", F.lit(" to "), "t", F.when(F.col("hypothesis_id") % 100 == 0, " [PMID:1]?").otherwise("?"))
    return h.select(F.col("hypothesis_id").alias("query"), text.alias("text"))


_QUESTIONS = """ask AS MATERIALIZED (SELECT DISTINCT h.hypothesis_id AS query, 'What links ' || s.name || ' to ' || t.name || CASE WHEN h.hypothesis_id % 100 = 0 THEN ' [PMID:1]?' ELSE '?' END AS text
FROM hypotheses h JOIN nodes s ON s.id = h.source_id JOIN nodes t ON t.id = h.target_id WHERE h.hypothesis_id % 50 = 0 AND s.name IS NOT NULL AND t.name IS NOT NULL)"""


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "source", F.try_element_at("metadata", F.lit("title")).alias("title"))


_DOCUMENTS = "corpus AS MATERIALIZED (SELECT doc_id AS doc, text, source, metadata['title'] AS title, NULL::VARCHAR AS pmid FROM documents)"


def _articles(spark, d):
    """The index of articles: the first of each pmid, title and abstract as text."""
    a = table(spark, d, "pubmed_articles").filter("pmid is not null").groupBy("pmid").agg(F.min_by(F.struct(F.col("article_id").alias("doc"), "title", "abstract"), "article_id").alias("a"))
    text = F.concat_ws("\n\n", *[F.when(F.trim(c) != "", F.trim(c)) for c in ("a.title", "a.abstract")])
    return a.select("a.doc", "pmid", "a.title", text.alias("text"), F.lit("pubmed").alias("source"))


_ARTICLES = """corpus AS MATERIALIZED (SELECT article_id AS doc, pmid, title, concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(abstract), '')) AS text, 'pubmed' AS source FROM pubmed_articles
  WHERE pmid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY article_id) = 1)"""

#: BM25 of ask over corpus: ranked.
_RANKED = f"""post AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest({_TOK.format("coalesce(text, '')")}) AS term FROM corpus) GROUP BY ALL),
asked AS (SELECT query, term, count(*) AS qf FROM (SELECT query, unnest({_TOK.format('text')}) AS term FROM ask) GROUP BY ALL),
doclen AS (SELECT doc, sum(tf) AS dl FROM post GROUP BY ALL), many AS (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT sum(dl) FROM doclen) AS words),
idf AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY ALL), many), low AS (SELECT 0.25 * avg(idf) AS f FROM idf),
scored AS (SELECT query, doc, sum(qf * CASE WHEN idf < 0 THEN f ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (words / n)))) AS score
  FROM post JOIN asked USING (term) JOIN idf USING (term) JOIN doclen USING (doc), low, many GROUP BY ALL),
ranked AS MATERIALIZED (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank, doc, score FROM scored)"""

#: Candidate strings of ask: cand.
_CANDIDATES = r"""words AS (SELECT query, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS whole, text, regexp_extract_all(text, '[A-Za-z0-9_-]+') AS w FROM ask),
every AS (SELECT query, list_concat([whole], regexp_extract_all(text, '"([^"]+)"', 1),
   list_filter(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')), lambda x: length(x) >= 6),
   list_filter(list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i + 1], ' ')), lambda x: length(x) >= 6),
   list_filter(w, lambda x: length(x) >= 3 AND regexp_matches(x, '[A-Z0-9]'))) AS c FROM words),
cand AS MATERIALIZED (SELECT query, pos, candidate FROM (SELECT query, unnest(generate_series(0, len(c) - 1)) AS pos, regexp_replace(unnest(c), '^\s+|\s+$', '', 'g') AS candidate FROM every) WHERE candidate <> ''
  QUALIFY row_number() OVER (PARTITION BY query, lower(candidate) ORDER BY pos) = 1)"""

#: Nodes the candidates name: matched.
_MATCHED = r"""exact AS MATERIALIZED (SELECT DISTINCT q, id, name FROM (SELECT DISTINCT lower(candidate) AS q FROM cand) JOIN nodes ON lower(trim(id)) = q OR lower(trim(name)) = q),
single AS (SELECT DISTINCT lower(candidate) AS q FROM cand WHERE NOT contains(candidate, ' ') AND lower(candidate) NOT IN (SELECT q FROM exact)),
named AS (SELECT q, id, name FROM exact UNION ALL SELECT q, id, name FROM single JOIN hay ON contains(hay.hay, q)),
best AS (SELECT q, id, name, row_number() OVER (PARTITION BY q ORDER BY (lower(name) <> q) NULLS LAST, lower(name) NULLS LAST, id) AS rank FROM named),
matched AS MATERIALIZED (SELECT c.query, c.pos, b.rank, b.id, b.name FROM cand c JOIN best b ON b.q = lower(c.candidate) WHERE b.rank <= 3)"""

#: Context of each query of ask: ctx.
_CONTEXT = _CANDIDATES + "," + _MATCHED + """,
near AS MATERIALIZED (SELECT source_id AS id, target_id AS other FROM edges WHERE source_id <> target_id UNION SELECT target_id, source_id FROM edges WHERE source_id <> target_id),
seeds AS MATERIALIZED (SELECT query, id, arg_min(name, pos * 10 + rank) AS name, min(pos * 10 + rank) AS place FROM matched GROUP BY ALL),
step1 AS MATERIALIZED (SELECT DISTINCT query, other AS id FROM seeds JOIN near USING (id)), step2 AS (SELECT DISTINCT query, other AS id FROM step1 JOIN near USING (id)),
inside AS MATERIALIZED (SELECT query, id FROM seeds UNION SELECT query, id FROM step1 UNION SELECT query, id FROM step2),
told AS (SELECT a.query, coalesce(s.name, s.id) || ' ' || e.edge_type || ' ' || coalesce(t.name, t.id) AS triple, row_number() OVER (PARTITION BY a.query ORDER BY e.score DESC, e.source_id, e.target_id, e.edge_type) AS rank
  FROM edges e JOIN inside a ON a.id = e.source_id JOIN inside b ON b.id = e.target_id AND b.query = a.query JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id),
ctx AS MATERIALIZED (SELECT query, size, entities, coalesce(triples, 0) AS triples, CASE WHEN triples > 0 THEN 'Relevant knowledge graph context:' || chr(10) || 'Matched entities: ' || entities || '.' || chr(10) || lines ELSE '' END AS context
  FROM (SELECT query, string_agg(coalesce(name, id), ', ' ORDER BY place, id) AS entities FROM seeds GROUP BY ALL) JOIN (SELECT query, count(*) AS size FROM inside GROUP BY ALL) USING (query)
  LEFT JOIN (SELECT query, count(*) AS triples, string_agg('- ' || triple, chr(10) ORDER BY rank) AS lines FROM told WHERE rank <= 50 GROUP BY ALL) USING (query))"""


def _reranked(fused: str, top: int) -> str:
    """SQL of the documents of ``fused`` (query, doc, score) reranked: found."""
    return f""", full_ AS (SELECT f.query, f.doc, f.score, {_TOK.format('a.text')} AS q, {_TOK.format("coalesce(coalesce(nullif(c.title, ''), CAST(c.doc AS VARCHAR)), '')")} AS ti,
  {_TOK.format("concat_ws(chr(10), coalesce(nullif(c.title, ''), CAST(c.doc AS VARCHAR)), nullif(c.text, ''), nullif(x.context, ''))")} AS al, c.source, coalesce(x.context, '') AS context
  FROM ({fused}) f JOIN ask a USING (query) JOIN corpus c USING (doc) LEFT JOIN ctx x USING (query)),
weighed AS (SELECT query, doc, score + len(list_intersect(list_distinct(q), list_distinct(al))) / len(list_distinct(q)) + CASE WHEN list_has_any(q, ti) THEN 0.15 ELSE 0 END + CASE WHEN source = 'pubmed' THEN 0.05 ELSE 0 END AS score FROM full_),
found AS MATERIALIZED (SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank, doc, score FROM weighed) WHERE rank <= {top})"""


def _twice(n: int) -> str:
    """SQL of a ranking fused with itself."""
    return f"SELECT query, doc, 2.0::DOUBLE / (60 + rank) AS score FROM ranked WHERE rank <= {n}"


_SENTENCE = r"regexp_extract(regexp_replace({}, '^\s+|\s+$', '', 'g'), '^((?s:.*?)[.!?])\s', 1)"


def _first_sentence(c: str) -> str:
    return f"coalesce(nullif({_SENTENCE.format(c)}, ''), regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


# --- context -----------------------------------------------------------------------------------------------------------


@query("WITH " + _TITLES.replace("WHERE article_id % 50 = 0 AND", "WHERE") + "," + _CANDIDATES + "SELECT query, CAST(pos AS BIGINT) AS pos, candidate FROM cand")
def r13_entity_candidates(spark, d):
    asked = table(spark, d, "pubmed_articles").filter("title is not null").select(F.col("article_id").alias("query"), F.col("title").alias("text"))
    return R.entity_candidates(asked).withColumn("pos", F.col("pos").cast("long"))


@query(GRAPH + HAY + "," + _QUESTIONS + "," + _CANDIDATES + "," + _MATCHED + "SELECT query, CAST(pos AS BIGINT) AS pos, CAST(rank AS BIGINT) AS rank, id, name FROM matched")
def r14_matched_nodes(spark, d):
    """Nodes that the candidate strings of questions name."""
    m = K.match_nodes(graph(spark, d), R.entity_candidates(_questions(spark, d)))
    return m.withColumns({c: F.col(c).cast("long") for c in ("pos", "rank")})


@query(GRAPH + HAY + "," + _QUESTIONS + "," + _CONTEXT + "SELECT query, entities, size, triples, md5(context) AS context FROM ctx")
def r16_graph_context(spark, d):
    """Matched entities, neighbourhood and best triples of questions, as text."""
    c = K.graph_context(graph(spark, d), _questions(spark, d))
    return c.select("query", F.array_join("entities", ", ").alias("entities"), "size", F.size("triples").cast("long").alias("triples"), F.md5("context").alias("context"))


@query(GRAPH + HAY + "," + _QUESTIONS + "," + _CONTEXT + "SELECT query, id FROM inside")
def q05_expansion(spark, d):
    """Nodes within two steps of the nodes that questions name."""
    kg = graph(spark, d)
    return K.expand(kg, K.match_nodes(kg, R.entity_candidates(_questions(spark, d))), depth=2)


# --- retrieval -----------------------------------------------------------------------------------------------------------


@query(GRAPH + HAY + "," + _TITLES + "," + _DOCUMENTS + "," + _RANKED + "," + _CONTEXT + """,
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), pairs AS (SELECT a.query, b.vec_id AS doc, list_cosine_similarity(v.e, b.e) AS score FROM ask a JOIN vec v ON v.vec_id = a.query, vec b WHERE b.vec_id IN (SELECT doc FROM corpus)),
closest AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank, doc FROM pairs)"""
       + _reranked("SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query, doc, rank FROM ranked WHERE rank <= 30 UNION ALL SELECT query, doc, rank FROM closest WHERE rank <= 30) GROUP BY ALL", 10)
       + "SELECT query, rank, doc, round(score, 6) AS score FROM found")
def r09_hybrid_retrieve(spark, d):
    """Titles as questions: lexical and dense rankings fused, given graph context and reranked, ten documents each."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = _titles(spark, d).join(v.withColumnRenamed("vec_id", "query"), "query", "left")
    found = K.retrieve(_documents(spark, d), asked, top=10, kg=graph(spark, d), vectors=v.withColumnRenamed("vec_id", "doc"))
    return found.select("query", "rank", "doc", F.round("score", 6).alias("score"))


@query(GRAPH + HAY + "," + _QUESTIONS + "," + _ARTICLES + "," + _RANKED + "," + _CONTEXT + _reranked(_twice(15), 5) + "SELECT query, rank, doc, round(score, 6) AS score FROM found")
def r10_claim_retrieval(spark, d):
    """Evidence for claims: the five best articles of each."""
    found = K.retrieve(_articles(spark, d), _questions(spark, d), top=5, kg=graph(spark, d))
    return found.filter("doc is not null").select("query", "rank", "doc", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS doc, coalesce(nullif(metadata['title'], ''), CAST(doc_id AS VARCHAR)) AS title, coalesce(nullif(source, ''), 'pubmed') AS source FROM documents")
def r11_hit_documents(spark, d):
    """Hits as documents: the title falls back to the id, the source to pubmed."""
    docs = _documents(spark, d)
    return K.as_documents(docs.select("doc"), docs).select("doc", "title", "source")


@query("SELECT 'all' AS what, NULL::VARCHAR AS vector_id, count(DISTINCT vector_id) AS n FROM documents UNION ALL SELECT 'one', vector_id, length(text) FROM documents WHERE doc_id % 50 = 0")
def r07_count_and_lookup(spark, d):
    """Number of documents in the store, and documents looked up by id."""
    t = table(spark, d, "documents")
    total = t.agg(F.count_distinct("vector_id").alias("n")).select(F.lit("all").alias("what"), F.lit(None).cast("string").alias("vector_id"), "n")
    asked = t.filter("doc_id % 50 = 0").select("vector_id")
    return total.unionByName(t.join(asked, "vector_id", "left_semi").select(F.lit("one").alias("what"), "vector_id", F.length("text").cast("long").alias("n")))


_ANSWERED = GRAPH + HAY + "," + _QUESTIONS + "," + _ARTICLES + "," + _RANKED + "," + _CONTEXT + _reranked(_twice(30), 10)


@query(_ANSWERED + """SELECT f.query, min(f.rank) AS rank, c.pmid, first(a.title) AS title, first(a.year) AS year, true AS known FROM found f JOIN corpus c USING (doc)
JOIN (SELECT pmid, title, year FROM pubmed_articles WHERE pmid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY article_id) = 1) a USING (pmid) WHERE f.rank <= 5 GROUP BY f.query, c.pmid""")
def r21_references(spark, d):
    """Articles that retrieved documents refer to, each once."""
    found = K.retrieve(_articles(spark, d), _questions(spark, d), top=10, kg=graph(spark, d)).filter("rank <= 5")
    return K.references(found, table(spark, d, "pubmed_articles")).drop("authors")


_TEXT = "regexp_replace(coalesce(c.text, ''), '^\\s+|\\s+$', '', 'g')"


@query(_ANSWERED + f""", kept AS (SELECT f.query, f.rank, coalesce(nullif(c.title, ''), CAST(c.doc AS VARCHAR)) AS title, c.pmid, {_first_sentence("coalesce(c.text, '')")} AS s FROM found f JOIN corpus c USING (doc) WHERE f.rank <= 5),
said AS (SELECT query, string_agg('- ' || title || ': ' || s || ' [PMID:' || pmid || ']', chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS lines, count(*) AS n, list_sort(list(pmid)) AS refs FROM kept GROUP BY ALL),
ans AS (SELECT a.query, CASE WHEN n > 0 THEN 'Evidence-grounded summary for: ' || text || chr(10) || lines ELSE 'I do not know based on the available abstracts for: ' || text END AS answer, coalesce(n, 0) AS n, coalesce(refs, []) AS refs FROM ask a LEFT JOIN said USING (query)),
cit AS (SELECT *, list_sort(list_distinct(regexp_extract_all(answer, '\\[(?:PMID:)?(\\d+)\\]', 1))) AS pmids FROM ans)
SELECT query, md5(answer) AS answer, array_to_string(pmids, '|') AS pmids, len(list_filter(pmids, lambda p: NOT list_contains(refs, p))) AS invalid,
 round(CASE WHEN n = 0 THEN 0.1 ELSE greatest(0, least(0.95, 0.55 + 0.35 * least(n / 5.0, 1.0) - CASE WHEN len(list_filter(pmids, lambda p: NOT list_contains(refs, p))) > 0 THEN 0.2 ELSE 0 END)) END, 6) AS confidence FROM cit""")
def o23_literature_answers(spark, d):
    """Questions answered by first sentences of the best articles, with citations and a confidence."""
    a = K.answer(graph(spark, d), _articles(spark, d), table(spark, d, "pubmed_articles"), _questions(spark, d))
    return a.select("query", F.md5("answer").alias("answer"), F.array_join("pmids", "|").alias("pmids"), F.col("invalid").cast("long").alias("invalid"), F.round("confidence", 6).alias("confidence"))


@query("WITH " + _TITLES + "," + _ARTICLES + "," + _RANKED + f""" SELECT query, string_agg('- ' || coalesce(nullif(c.title, ''), CAST(c.doc AS VARCHAR)) || ': ' || {_first_sentence("coalesce(c.text, '')")} || ' [PMID:' || c.pmid || ']', chr(10) ORDER BY rank) AS answer
FROM ranked JOIN corpus c USING (doc) WHERE rank <= 3 GROUP BY ALL""")
def r24_extractive_answers(spark, d):
    """Title, first sentence and citation of the three best articles for each title."""
    docs = _articles(spark, d)
    best = K.as_documents(R.bm25(docs.select("doc", "text"), _titles(spark, d), top=3), docs)
    x = F.struct("rank", K.extractive_line(F.col("title"), F.coalesce("text", F.lit("")), F.col("pmid")).alias("s"))
    return best.select("query", x.alias("x")).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("answer"))


# --- verification ----------------------------------------------------------------------------------------------------------

_SUPPORT = f"""top1 AS (SELECT query, doc FROM ranked WHERE rank = 1),
cited AS MATERIALIZED (SELECT query, doc FROM top1 JOIN ask USING (query) JOIN corpus c USING (doc) WHERE len(list_intersect(list_distinct({_TOK.format('ask.text')}), list_distinct({_TOK.format("coalesce(c.text, '')")}))) >= 2)"""
_ENTITIES = "ents AS MATERIALIZED (SELECT query, id, node_type, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM ask JOIN nodes ON length(name) > 0 AND contains(lower(ask.text), lower(name)))"


@query(GRAPH + "," + _QUESTIONS + "," + _ARTICLES + "," + _RANKED + "," + _SUPPORT + "SELECT query, doc FROM cited")
def o08_literature_support(spark, d):
    """Claims whose best article shares two words or more with them."""
    return K.literature_supported(_articles(spark, d), _questions(spark, d))


@query(GRAPH + "," + _QUESTIONS + "," + _ENTITIES + "SELECT query, rank, id, node_type FROM ents WHERE rank <= 2")
def l12_claim_entities(spark, d):
    """The first two nodes whose name stands in a claim."""
    return K.substring_entities(slim_graph(spark, d), _questions(spark, d), limit=2)


@query(GRAPH + "," + _QUESTIONS + """, ents AS (SELECT query, id, node_type, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM ask JOIN nodes ON length(name) > 0 AND node_type IN ('Gene', 'Disease') AND contains(lower(ask.text), lower(name)))
SELECT query, rank, id, node_type FROM ents WHERE rank <= 5""")
def l11_clause_entities(spark, d):
    """The first five genes and diseases whose name stands in a clause."""
    return K.substring_entities(slim_graph(spark, d), _questions(spark, d), limit=5, node_types=["Gene", "Disease"])


_VERIFIED = GRAPH + "," + _QUESTIONS + "," + _ARTICLES + "," + _RANKED + "," + _SUPPORT + "," + _ENTITIES + r""",
two AS (SELECT query, min(id) AS u, max(id) AS v FROM ents WHERE rank <= 2 GROUP BY ALL HAVING count(*) = 2),
checks AS MATERIALIZED (SELECT a.query, a.text, t.u IS NOT NULL AS two, EXISTS (SELECT 1 FROM und WHERE und.u = t.u AND und.v = t.v) AS linked, a.query IN (SELECT query FROM cited) AS cited FROM ask a LEFT JOIN two t USING (query)),
verdict AS (SELECT query, (two AND linked) OR cited AS supported, CASE WHEN (two AND linked) OR cited THEN NULL WHEN two THEN 'No direct KG evidence for claim: ' || text WHEN NOT regexp_matches(text, '\[[^\]]+\]') THEN 'Insufficiently grounded claim: ' || text END AS issue FROM checks)
"""


@query(_VERIFIED + "SELECT query, supported, issue FROM verdict")
def o07_verify_claims(spark, d):
    """Claims checked against edges of the graph and the literature."""
    return K.verify(slim_graph(spark, d), _articles(spark, d), _questions(spark, d))


@query(_VERIFIED + """, s AS (SELECT query % 7 AS part, count(*) AS claims, count(*) FILTER (WHERE supported) AS supported, count(DISTINCT issue) AS issues FROM verdict GROUP BY ALL)
SELECT part, claims, supported, issues, round(greatest(0, least(0.95, 0.35 + 0.55 * supported / claims - least(0.1 * issues, 0.5))), 6) AS confidence FROM s""")
def o09_verification_confidence(spark, d):
    """Claims of several texts summed up to a confidence."""
    v = K.verify(slim_graph(spark, d), _articles(spark, d), _questions(spark, d)).withColumn("part", F.col("query") % 7)
    return K.verification(v, "part").select("part", "claims", "supported", F.size("issues").cast("long").alias("issues"), F.round("confidence", 6).alias("confidence"))


# --- reviews ---------------------------------------------------------------------------------------------------------------


def _topics(spark, d):
    """Every article whose id is divisible by 50: its first keyword, else its title, is a topic."""
    a = table(spark, d, "pubmed_articles").filter("article_id % 50 = 0")
    return a.select(F.col("article_id").alias("query"), F.coalesce(F.try_element_at("keywords", F.lit(1)), "title").alias("topic")).filter("topic is not null")


def _section_sql(n: int) -> str:
    rows = ", ".join(f"({i}, '{h}', '{q}')" for i, (h, q) in enumerate(list(K.SECTIONS.items())[:n]))
    return f"""topics AS (SELECT article_id AS topic_id, coalesce(keywords[1], title) AS topic FROM pubmed_articles WHERE article_id % 50 = 0 AND coalesce(keywords[1], title) IS NOT NULL),
sections AS MATERIALIZED (SELECT topic_id, topic, pos, heading, replace(q, '{{}}', topic) AS question FROM topics, (VALUES {rows}) s(pos, heading, q)),
ask AS MATERIALIZED (SELECT topic_id || '#' || pos AS query, topic || ' ' || heading || ' ' || question AS text FROM sections)"""


@query(GRAPH + HAY + "," + _section_sql(3) + "," + _ARTICLES + "," + _RANKED + "," + _CONTEXT + _reranked(_twice(18), 6) + f""",
lines AS (SELECT query, string_agg('- ' || {_first_sentence("coalesce(c.text, '')")} || ' [PMID:' || c.pmid || ']', chr(10) ORDER BY rank) AS lines FROM found JOIN corpus c USING (doc) WHERE rank <= 3 GROUP BY ALL),
content AS (SELECT s.*, CASE WHEN l.lines IS NOT NULL THEN heading || '.' || chr(10) || 'This section addresses: ' || question || chr(10) || l.lines ELSE heading || '.' || chr(10) || 'Insufficient evidence was retrieved to answer: ' || question END AS content
  FROM sections s LEFT JOIN lines l ON l.query = s.topic_id || '#' || s.pos),
whole AS (SELECT topic_id AS query, '# Narrative Review of ' || topic || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || 'This rapid narrative review summarizes local evidence for ' || topic || '. It covers ' || string_agg(heading, ', ' ORDER BY pos) || '.' || chr(10) || chr(10)
  || string_agg('## ' || heading || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY pos) AS review FROM content GROUP BY topic_id, topic)
SELECT query, md5(review) AS review, array_to_string(list_distinct(list_sort(regexp_extract_all(review, '\\[(?:PMID:)?(\\d+)\\]', 1))), '') <> '' AS cites FROM whole""")
def o13_fast_review(spark, d):
    """Reviews of topics from three fixed sections."""
    r = K.review(graph(spark, d), _articles(spark, d), _topics(spark, d))
    return r.select("query", F.md5("review").alias("review"), (F.size("pmids") > 0).alias("cites"))


@query()
def o14_full_review(spark, d):
    """Reviews of topics from all four sections, each the first of three drafts that is good enough.

    The drafts of a section rest on ever more documents; each is scored, and the first above seven, else the last, is kept."""
    s = checkpoint(K.review_sections(_topics(spark, d), sections=4))
    found = K.retrieve(_articles(spark, d), s.select("query", "text"), top=15, kg=graph(spark, d))
    kept = K.revise(K.section_drafts(s, found))
    return kept.select("query", "round", F.md5("content").alias("content"), "score")
